"""Online smoothing of a static table: a bounded trailing window per row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline import errors as E
from driftline.config import SmootherConfig
from driftline.operators.numeric import online_value, window_values
from driftline.operators.series import map_series, numbers

#: Rows of a series that are worked off together at least; the rows of the window before them come along.
SEGMENT = 4096
_NEW = ("y_smooth", "residual", "rob_weight")


def online_rows(x: np.ndarray, y: np.ndarray, position: np.ndarray, c: SmootherConfig) -> dict[str, np.ndarray]:
    """y_smooth, residual, rob_weight and iterations_used of every point as it arrives, NaN until there are enough; and window_rows.

    The arrays hold series one after another; ``position`` counts the points of its series before each, and the rows of
    its window stand before it. Points with windows of one size are fitted together.
    """
    out = {k: np.full(len(y), np.nan) for k in (*_NEW, "iterations_used")}
    size = out["window_rows"] = np.minimum(position + 1, c.window_capacity)
    stacked = c.update_mode == "incremental" and c.surface_mode == "direct" and c.boundary_policy == "none"
    for n in np.unique(size[size >= c.min_points]).tolist():
        at = np.flatnonzero(size == n)
        if stacked and n > 2:
            out["y_smooth"][at], out["rob_weight"][at], out["iterations_used"][at] = window_values(x, y, at, n, c), 1.0, 1
            continue
        for k in at.tolist():
            out["y_smooth"][k], out["rob_weight"][k], out["iterations_used"][k] = online_value(x[k + 1 - n : k + 1], y[k + 1 - n : k + 1], c)
    out["residual"] = y - out["y_smooth"]
    return out


def fit_online(df: DataFrame, keys: list[str], x: list[str], y: str, c: SmootherConfig, order_by: list[str] | None = None) -> DataFrame:
    """``df`` with y_smooth, residual, rob_weight, iterations_used and window_rows (points in the window) per row, in the order of ``order_by``.

    Series are split into segments of rows, each with the rows of the window before it, so a long series fills as
    many tasks as it has segments.
    """
    order = order_by or x
    own = Window.partitionBy(*keys).orderBy(*order)
    length, before = max(SEGMENT, c.window_capacity), c.window_capacity - 1
    rows = df.withColumn("_row", F.row_number().over(own).cast("long") - 1)
    segment = F.floor(F.col("_row") / length)
    ahead = F.when((segment + 1) * length - F.col("_row") <= before, F.array(segment, segment + 1)).otherwise(F.array(segment))
    rows = rows.withColumn("_segment", F.explode(ahead))

    def work(table: pa.Table, starts: np.ndarray) -> dict:
        points, values = numbers(table, x), numbers(table, [y])[:, 0]
        if not (np.isfinite(points).all() and np.isfinite(values).all()):
            raise E.InvalidNumericValue("predictors and responses must be finite")
        row, at = table.column("_row").to_numpy(), table.column("_segment").to_numpy()
        new = row // length == at
        made = online_rows(points, values, np.where(new, row, -1), c)
        return {k: pa.array(made[k], pa.float64(), from_pandas=True) for k in _NEW} | {"iterations_used": pa.array(made["iterations_used"], pa.float64(), from_pandas=True).cast(pa.int32()), "window_rows": pa.array(made["window_rows"]).cast(pa.int32()), None: new}

    fields = [*(T.StructField(k, T.DoubleType()) for k in _NEW), T.StructField("iterations_used", T.IntegerType()), T.StructField("window_rows", T.IntegerType())]
    return map_series(rows, [*keys, "_segment"], ["_row"], work, fields, ["_row", "_segment"])
