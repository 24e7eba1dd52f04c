"""Many series, each fitted whole in an Arrow batch (any dimension, any option)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from driftline import errors as E
from driftline.config import SmootherConfig
from driftline.operators.numeric import TIED, Fit, cross_validate, fit_series, predict, span, window_se
from driftline.operators.series import map_series, numbers

_HAT = ("enp", "trace_hat", "delta1", "delta2", "residual_scale")
_DIAGNOSTICS = ("rmse", "mae", "r_squared", "aic", "aicc", "effective_df", "residual_sd")


def point_fields(c: SmootherConfig) -> list[str]:
    """Columns that a fit adds to each row; absent ones were not asked for."""
    out = ["y_smooth"]
    if c.wants_errors:
        out.append("std_err")
    if c.confidence_level is not None:
        out += ["conf_lower", "conf_upper"]
    if c.prediction_level is not None:
        out += ["pred_lower", "pred_upper"]
    if c.return_residuals:
        out.append("residual")
    if c.return_robustness_weights:
        out.append("rob_weight")
    if c.wants_errors and c.surface_mode == "direct":
        out.append("leverage")
    return out


def summary_type(c: SmootherConfig) -> T.StructType:
    """One value per series."""
    out = T.StructType().add("iterations_used", "integer").add("fraction_used", "double").add("dimensions", "integer").add("distance_metric", "string").add("polynomial_degree", "integer")
    if c.cross_validation:
        out.add("cv_scores", T.ArrayType(T.DoubleType()))
    if c.wants_errors and c.surface_mode == "direct":
        for k in _HAT:
            out.add(k, "double")
    if c.return_diagnostics:
        out.add("diagnostics", T.StructType([T.StructField(k, T.DoubleType()) for k in _DIAGNOSTICS]))
    return out


def _columns(fit: Fit, y: np.ndarray, c: SmootherConfig) -> dict[str, np.ndarray]:
    have = {"y_smooth": fit.y, "std_err": fit.std_err, "residual": y - fit.y, "rob_weight": fit.weights, "leverage": fit.leverage}
    for name in fit.lower:
        have |= {f"{name}_lower": fit.lower[name], f"{name}_upper": fit.upper[name]}
    return {k: have[k] for k in point_fields(c)}


def _summary(fit: Fit, c: SmootherConfig) -> dict:
    out = {"iterations_used": fit.iterations_used, "fraction_used": fit.fraction, "dimensions": c.dimensions, "distance_metric": c.distance_metric, "polynomial_degree": c.degree}
    if c.cross_validation:
        out["cv_scores"] = fit.cv_scores
    if c.wants_errors and c.surface_mode == "direct":
        out |= fit.hat
    if c.return_diagnostics:
        out["diagnostics"] = fit.diagnostics
    return out


def checked(df: DataFrame, x: list[str], y: str, na: str = "raise") -> DataFrame:
    """``df`` without rows that have a null or non-finite value (``drop``), or an error in the job (``raise``)."""
    bad = F.lit(False)
    for c in [*x, y]:
        v = F.col(c).cast("double")
        bad = bad | F.coalesce(v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(True))
    if na == "drop":
        return df.filter(~bad)
    return df.withColumn("_ok", F.when(bad, F.raise_error(F.lit("predictors and responses must be finite"))).otherwise(True)).filter("_ok").drop("_ok")


def fit_groups(df: DataFrame, keys: list[str], x: list[str], y: str, c: SmootherConfig, order_by: list[str] | None = None, na: str = "raise", max_group_rows: int | None = None, custom_fit: Callable[[np.ndarray, np.ndarray, SmootherConfig], Fit] | None = None) -> DataFrame:
    """``df`` with the columns of ``point_fields`` and, in the first row of each series, ``_summary``.

    Rows of a series are taken in the order of ``order_by``, by default the predictors. Without keys the
    whole table is one series. ``custom_fit`` takes the place of the built-in fit of a series. A task holds a whole series
    and fits it in blocks of bounded size; ``max_group_rows`` refuses longer ones, for which plans.surface takes many tasks.
    """
    if len(x) != c.dimensions:
        raise E.MismatchedInputs(f"{len(x)} predictor columns, {c.dimensions} dimensions")
    order = order_by or x
    summary = to_arrow_type(summary_type(c))

    def work(table: pa.Table, starts: np.ndarray) -> dict:
        points, values = numbers(table, x), numbers(table, [y])[:, 0]
        parts: dict[str, list[np.ndarray]] = {k: [] for k in point_fields(c)}
        facts: list[dict | None] = [None] * len(values)
        for first, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if max_group_rows and end - first > max_group_rows:
                raise E.InvalidInput(f"a series has {end - first} rows, more than {max_group_rows}; one-dimensional ones can be fitted by fit_surface")
            fit = (custom_fit or fit_series)(points[first:end], values[first:end], c)
            for k, v in _columns(fit, values[first:end], c).items():
                parts[k].append(v)
            facts[first] = _summary(fit, c)
        return {k: np.concatenate(v) for k, v in parts.items()} | {"_summary": pa.array(facts, summary)}

    new = [*(T.StructField(k, T.DoubleType()) for k in point_fields(c)), T.StructField("_summary", summary_type(c))]
    return map_series(checked(df, x, y, na), keys, order, work, new)


def predict_groups(train: DataFrame, queries: DataFrame, keys: list[str], x: list[str], y: str, c: SmootherConfig) -> DataFrame:
    """``queries`` with ``y_smooth``: direct fits at any points of the series of ``train``."""
    schema = T.StructType([*queries.schema.fields, T.StructField("y_smooth", T.DoubleType())])

    def run(known: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return asked.assign(y_smooth=pd.Series(dtype=float))
        if not len(known):
            return asked.assign(y_smooth=np.nan)
        known = known.sort_values(x, kind="stable")
        return asked.assign(y_smooth=predict(known[x].to_numpy(np.float64), known[y].to_numpy(np.float64), asked[x].to_numpy(np.float64), c))

    return train.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInPandas(run, schema)


def window_errors(df: DataFrame, keys: list[str], x: str, y: str, fitted: str, c: SmootherConfig) -> DataFrame:
    """``df`` with ``std_err``: local residual variances of a given fit in windows of the span, by series."""

    def work(table: pa.Table, starts: np.ndarray) -> dict:
        at, values, fit = (numbers(table, [k])[:, 0] for k in (x, y, fitted))
        pairs = zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)
        return {"std_err": np.concatenate([window_se(at[a:b], values[a:b], fit[a:b], c.weight_function, span(b - a, c.fraction)) for a, b in pairs])}

    return map_series(df, keys, [x], work, [T.StructField("std_err", T.DoubleType())])


def cross_validate_groups(df: DataFrame, keys: list[str], x: list[str], y: str, c: SmootherConfig) -> DataFrame:
    """keys, fraction, score, best: every candidate span of every series is a group of its own.

    The table is exploded by candidate, so a few series with many candidates still fill a cluster.
    """
    cv = c.cross_validation
    rows = df.select(*keys, *x, y, F.posexplode(F.array(*map(F.lit, cv.fractions))).alias("_at", "fraction"))

    def work(table: pa.Table, starts: np.ndarray) -> dict:
        points, values, fractions = numbers(table, x), numbers(table, [y])[:, 0], numbers(table, ["fraction"])[:, 0]
        scores = np.full(len(values), np.nan)
        for first, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            own = c.but(cross_validation=replace(cv, fractions=(float(fractions[first]),)))
            scores[first] = cross_validate(points[first:end], values[first:end], own)[1][0]
        return {"score": scores, None: ~np.isnan(scores)}

    scored = map_series(rows, [*keys, "_at"], x, work, [T.StructField("score", T.DoubleType())], [*x, y])
    series = Window.partitionBy(*keys)  # one row per candidate
    scored = scored.withColumn("_least", F.min("score").over(series))
    best = F.min(F.when(F.col("score") <= F.col("_least") * (1 + TIED), F.col("_at"))).over(series)
    return scored.select(*keys, "fraction", "score", (F.col("_at") == best).alias("best"))
