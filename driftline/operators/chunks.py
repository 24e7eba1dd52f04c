"""Chunked smoothing of long series on a static table: overlapping blocks, fitted apart and merged at the seams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.config import SmootherConfig
from driftline.operators.numeric import merged, smooth
from driftline.operators.series import map_series, numbers


#: Consecutive blocks of a series that a task works off together.
TOGETHER = 64


def last_block(n: Column, c: SmootherConfig) -> Column:
    """The last block of a series of ``n`` rows.

    A block takes ``chunk_size`` new rows after the ``overlap`` last rows of the one before; a rest that is
    shorter than the overlap joins the last block, so every block can hand on a full overlap.
    """
    return F.greatest(F.lit(0), F.floor((n - 1) / c.chunk_size) - ((n - 1) % c.chunk_size + 1 < c.overlap).cast("int")).cast("int")


def fit_chunks(df: DataFrame, keys: list[str], x: list[str], y: str, c: SmootherConfig, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with ``chunk``, ``y_smooth``, ``residual`` and ``rob_weight``, each row once, in the block that emits it.

    A task gets ``TOGETHER`` blocks of a series with the block before them, whose fit the first of them is merged with. So
    blocks meet without a second shuffle, and a long series fills as many tasks as it has such stretches.
    """
    order, chunk, overlap = order_by or x, c.chunk_size, c.overlap
    key = Window.partitionBy(*keys)
    rows = df.withColumn("_row", F.row_number().over(key.orderBy(*order)).cast("long") - 1).withColumn("_n", F.count("*").over(key))
    own = F.least(F.floor(F.col("_row") / chunk).cast("int"), last_block(F.col("_n"), c))
    rows = rows.withColumn("_last", last_block(F.col("_n"), c)).withColumn("_own", own)
    shared = (F.col("_own") < F.col("_last")) & ((F.col("_own") + 1) * chunk - F.col("_row") <= overlap)  # with the next block
    rows = rows.withColumn("_emit", F.col("_own") + shared.cast("int"))
    stretch = lambda b: F.floor(b / TOGETHER).cast("int")
    # the stretch of the row's blocks, and the next one if it begins with the block after them
    rows = rows.withColumn("_stretch", F.explode(F.array_distinct(F.array(stretch(F.col("_own")), stretch(F.least(F.col("_emit") + 1, F.col("_last")))))))

    def work(table: pa.Table, starts: np.ndarray) -> dict:
        points, values = numbers(table, x), numbers(table, [y])[:, 0]
        row, last, emit, at = (table.column(k).to_numpy() for k in ("_row", "_last", "_emit", "_stretch"))
        out = {k: np.full(len(values), np.nan) for k in ("y_smooth", "rob_weight")}
        for first, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            base, top = int(row[first]), int(last[first])
            lead = int(at[first]) * TOGETHER
            earlier: tuple[int, np.ndarray, np.ndarray] | None = None  # where the block before ends, and its fit of the overlap
            for b in range(max(0, lead - 1), min(top, lead + TOGETHER - 1) + 1):
                low = first + max(b * chunk - (overlap if b else 0), 0) - base
                high = end if b == top else first + (b + 1) * chunk - base
                fit = smooth(points[low:high], values[low:high], c) if high - low > 1 else None
                value, weight = (values[low:high], np.ones(high - low)) if fit is None else (fit.y.copy(), fit.weights.copy())
                if earlier is not None and overlap:
                    n = min(overlap, high - low)
                    value[:n], weight[:n] = merged(earlier[1], value[:n], c.merge_strategy), merged(earlier[2], weight[:n], c.merge_strategy)
                # the last rows stay as fitted for the next block, which merges them
                tail = high - overlap if b < top and overlap else high
                if fit is not None:
                    earlier = (high, fit.y[len(value) - (high - tail) :], fit.weights[len(value) - (high - tail) :])
                else:
                    earlier = (high, value[len(value) - (high - tail) :], weight[len(value) - (high - tail) :])
                if b >= lead:
                    out["y_smooth"][low:tail], out["rob_weight"][low:tail] = value[: tail - low], weight[: tail - low]
        return out | {"residual": values - out["y_smooth"], "chunk": emit, None: emit // TOGETHER == at}

    new = [T.StructField("chunk", T.IntegerType()), *(T.StructField(k, T.DoubleType()) for k in ("y_smooth", "residual", "rob_weight"))]
    return map_series(rows, [*keys, "_stretch"], ["_row"], work, new, ["_row", "_n", "_last", "_own", "_emit", "_stretch"])


def cumulative_diagnostics(chunked: DataFrame, keys: list[str], y: str) -> DataFrame:
    """keys, chunk, rmse, mae, r_squared, residual_sd over all rows up to and with each chunk."""
    r = F.col("residual")
    sums = chunked.groupBy(*keys, "chunk").agg(F.count("*").alias("n"), F.sum(y).alias("sy"), F.sum(F.col(y) * F.col(y)).alias("syy"), F.sum(r).alias("sr"), F.sum(r * r).alias("srr"), F.sum(F.abs(r)).alias("sa"))
    upto = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    run = sums.select(*keys, "chunk", *(F.sum(k).over(upto).alias(k) for k in ("n", "sy", "syy", "sr", "srr", "sa")))
    tss = F.col("syy") - F.col("sy") * F.col("sy") / F.col("n")
    r2 = F.when(tss <= 1e-12 * F.col("syy"), F.when(F.col("srr") <= 1e-12 * F.col("syy"), 1.0).otherwise(0.0)).otherwise(1 - F.col("srr") / tss)
    sd = F.when(F.col("n") > 1, F.sqrt(F.greatest(F.lit(0.0), (F.col("srr") - F.col("sr") * F.col("sr") / F.col("n")) / (F.col("n") - 1)))).otherwise(0.0)
    return run.select(*keys, "chunk", F.sqrt(F.col("srr") / F.col("n")).alias("rmse"), (F.col("sa") / F.col("n")).alias("mae"), r2.alias("r_squared"), sd.alias("residual_sd"))
