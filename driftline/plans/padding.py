"""Boundary padding of series as a union of the rows with generated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pad_series(series: DataFrame, key: str, policy: str) -> DataFrame:
    """key, x, y, source (rank of the row whose robustness weight a row takes) for ``series`` (key, x, y, n, q)."""
    own = Window.partitionBy(key).orderBy("x")
    rows = series.withColumn("_r", F.row_number().over(own)).withColumn("_k", F.least(F.floor(F.col("q") / 2), F.col("n") - 1))
    plain = rows.select(key, "x", "y", F.col("_r").cast("long").alias("source"))
    if policy == "none":
        return plain
    at = lambda r, c: F.max(F.when(F.col("_r") == r, F.col(c)))
    n = F.col("n")
    ends = rows.groupBy(key).agg(
        F.first("n").alias("n"), F.first("_k").alias("_k"), at(1, "x").alias("_x0"), at(2, "x").alias("_x1"), at(1, "y").alias("_y0"),
        F.max("x").alias("_xn"), at(n - 1, "x").alias("_xm"), at(n, "y").alias("_yn"),
    )
    if policy == "reflect":
        inner = rows.join(ends.select(key, "_x0", "_xn"), key)
        head = inner.filter((F.col("_r") > 1) & (F.col("_r") <= F.col("_k") + 1)).select(key, (2 * F.col("_x0") - F.col("x")).alias("x"), "y", F.lit(1).cast("long").alias("source"))
        tail = inner.filter((F.col("_r") < n) & (F.col("_r") >= n - F.col("_k"))).select(key, (2 * F.col("_xn") - F.col("x")).alias("x"), "y", n.alias("source"))
    else:
        step = ends.filter("_k > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_k"))))
        value = lambda c: F.lit(0.0) if policy == "zero" else F.col(c)
        head = step.select(key, (F.col("_x0") - F.col("_i") * (F.col("_x1") - F.col("_x0"))).alias("x"), value("_y0").alias("y"), F.lit(1).cast("long").alias("source"))
        tail = step.select(key, (F.col("_xn") + F.col("_i") * (F.col("_xn") - F.col("_xm"))).alias("x"), value("_yn").alias("y"), n.alias("source"))
    return plain.unionByName(head).unionByName(tail)
