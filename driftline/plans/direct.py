"""Direct local fits of one-dimensional series as DataFrame plans, without Python.

x must be the rank of a row in its series (1, 2, ...). The q nearest rows of a place are then one stretch of ranks,
whose ends follow from the place, q and the number of rows. So neighbours are found without sorting, by an equi join
by series and rank bucket, and the sums of a place are taken where its neighbours are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftline.functions import columns as C
from driftline.sources.intermediate import stored


def with_span(series: DataFrame, fraction: float) -> DataFrame:
    return series.withColumn("q", C.span("n", fraction))


def neighbours(series: DataFrame, key: str, at: DataFrame | None = None, exclude_self: bool = False) -> DataFrame:
    """Rows (key, qx, x, y, d, n, q, ...) of the q nearest of every query, of two equally near the lower one; ``reach`` is the largest d.

    ``series`` needs x, y, n, q. Ranks are put in buckets of q; a query meets its own bucket and the ones beside it, where
    its q nearest lie. ``at`` are queries (key, qx), by default all rows. ``exclude_self``
    leaves the row of the query out of its q nearest.
    """
    bucket = lambda x: F.floor(F.col(x) / F.col("q")).cast("long")
    if at is None:
        queries = series.select(key, F.col("x").alias("qx"), "n", "q")
    else:
        queries = at.join(series.groupBy(key).agg(F.first("n").alias("n"), F.first("q").alias("q")), key).select(key, "qx", "n", "q")
    first = F.greatest(F.lit(1), F.least(F.ceil(F.col("qx") - F.col("q") / 2), F.col("n") - F.col("q") + 1)).cast("double")
    queries = queries.withColumn("_first", first).withColumn("_last", F.col("_first") + F.col("q") - 1)
    queries = queries.withColumn("reach", F.greatest(F.abs(F.col("qx") - F.col("_first")), F.abs(F.col("_last") - F.col("qx"))))
    # a stretch of q ranks lies in two buckets at most; a query goes to both, and each rank stays in its own
    queries = queries.withColumn("_b", F.explode(F.array_distinct(F.array(bucket("_first"), bucket("_last"))))).drop("n", "q")
    # each query meets q rows: a number of partitions is given, as AQE would merge those of small tables before they grow
    parts = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda df: df.repartition(parts, key, "_b")
    near = dealt(queries).join(dealt(series.withColumn("_b", bucket("x"))), [key, "_b"]).filter("x BETWEEN _first AND _last")
    near = near.filter("x <> qx") if exclude_self else near
    return near.withColumn("d", F.abs(F.col("x") - F.col("qx"))).drop("_first", "_last")


def weighted(near: DataFrame, kernel: str = "tricube", robust: str | None = None) -> DataFrame:
    """``near`` with the kernel weight ``w``, times a robustness weight column."""
    w = C.kernel(kernel, F.when(F.col("reach") > 0, F.col("d") / F.col("reach")).otherwise(F.col("d")))
    return near.withColumn("w", w if robust is None else w * F.col(robust))


def moments(near: DataFrame, key: str, degree: int) -> DataFrame:
    """Per query s0..s2k = sum w (x - qx)^i and t0..tk = sum w (x - qx)^i y; combined before the shuffle."""
    dx = F.col("x") - F.col("qx")

    def power(k: int) -> Column:
        out = F.col("w")
        for _ in range(k):
            out = out * dx
        return out

    sums = [F.sum(power(k)).alias(f"s{k}") for k in range(2 * degree + 1)] + [F.sum(power(k) * F.col("y")).alias(f"t{k}") for k in range(degree + 1)]
    return near.groupBy(key, "qx").agg(*sums, F.avg("y").alias("plain"))


def value(degree: int) -> Column:
    """The fitted value from moments: weighted mean, line or parabola (Cramer's rule)."""
    c = F.col
    if degree == 0:
        fit = c("t0") / c("s0")
    elif degree == 1:
        fit = C.linear_at_zero("s0", "s1", "s2", "t0", "t1")
    else:
        det = c("s0") * (c("s2") * c("s4") - c("s3") * c("s3")) - c("s1") * (c("s1") * c("s4") - c("s3") * c("s2")) + c("s2") * (c("s1") * c("s3") - c("s2") * c("s2"))
        top = c("t0") * (c("s2") * c("s4") - c("s3") * c("s3")) - c("s1") * (c("t1") * c("s4") - c("s3") * c("t2")) + c("s2") * (c("t1") * c("s3") - c("s2") * c("t2"))
        fit = top / det
    return F.when(c("s0") <= 2.220446049250313e-16, c("plain")).otherwise(fit)


def fit_direct(series: DataFrame, key: str, degree: int = 1, kernel: str = "tricube", at: DataFrame | None = None) -> DataFrame:
    """key, qx, fit, leverage of every row of ``series`` (key, x, y, n, q), or of the queries ``at``."""
    m = moments(weighted(neighbours(series, key, at), kernel), key, degree)
    lever = C.linear_leverage("s0", "s1", "s2") if degree == 1 else 1 / F.col("s0")
    return m.select(key, "qx", value(degree).alias("fit"), lever.alias("leverage"))


def robust_scales(fitted: DataFrame, key: str, method: str = "mad") -> DataFrame:
    """Scale of the absolute residuals ``r`` of each series, with exact medians."""
    mid = fitted.groupBy(key).agg(F.median("r").alias("_m"), F.avg("r").alias("_mean"))
    if method == "mar":
        return mid.select(key, C.guarded_scale("_m", "_mean").alias("scale"))
    spread = fitted.join(mid, key).groupBy(key).agg(F.median(F.abs(F.col("r") - F.col("_m"))).alias("_s"), F.first("_mean").alias("_mean"))
    return spread.select(key, C.guarded_scale("_s", "_mean").alias("scale"))


def fit_robust(series: DataFrame, key: str, degree: int = 1, kernel: str = "tricube", method: str = "bisquare", scaling: str = "mad", passes: int = 1) -> DataFrame:
    """key, x, y, fit, rw after ``passes`` reweightings; new weights join the rows, not the pairs of neighbours."""

    def fitted(rows: DataFrame, robust: str | None) -> DataFrame:
        fit = moments(weighted(neighbours(rows, key), kernel, robust), key, degree).select(key, F.col("qx").alias("x"), value(degree).alias("fit"))
        return rows.join(fit, [key, "x"])

    rows = fitted(series, None).withColumn("rw", F.lit(1.0))
    for _ in range(passes):
        rows = stored(rows.withColumn("r", F.abs(F.col("y") - F.col("fit"))), "robust-pass")  # read for the scales and for the next pass
        weight = C.robustness_weight(method, "r", "scale")
        rows = fitted(rows.join(robust_scales(rows, key, scaling), key).withColumn("rw", weight).drop("r", "scale", "fit"), "rw")
    return rows.select(key, "x", "y", "fit", "rw")
