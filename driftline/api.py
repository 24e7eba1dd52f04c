"""The public face: a smoother for DataFrames, a chainable builder, a table function and a text report."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import errors as E
from driftline.config import CrossValidation, SmootherConfig
from driftline.operators import chunks, grouped, online
from driftline.operators.numeric import fit_series
from driftline.plans import surface
from driftline.streaming import stateful


def _list(value: str | list[str] | None) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


class Smoothed:
    """Points (one row per input row) and summary (one row per series) of a fit."""

    def __init__(self, rows: DataFrame, keys: list[str], config: SmootherConfig):
        self.rows, self.keys, self.config = rows, keys, config

    @property
    def points(self) -> DataFrame:
        return self.rows.drop("_summary")

    @property
    def summary(self) -> DataFrame:
        return self.rows.filter(F.col("_summary").isNotNull()).select(*self.keys, "_summary.*")

    @property
    def has_confidence_intervals(self) -> bool:
        return "conf_lower" in self.rows.columns

    @property
    def has_prediction_intervals(self) -> bool:
        return "pred_lower" in self.rows.columns

    @property
    def has_cv_scores(self) -> bool:
        return self.config.cross_validation is not None

    def best_cv_score(self) -> DataFrame:
        """The least cross-validation score of each series."""
        return self.summary.select(*self.keys, F.array_min("cv_scores").alias("best_cv_score"))


class Smoother:
    """Local regression over DataFrames; options are those of SmootherConfig."""

    def __init__(self, config: SmootherConfig | None = None, **options: Any):
        self.config = config or SmootherConfig(**options)

    def fit(self, df: DataFrame, x: str | list[str], y: str, partition_by: str | list[str] | None = None, order_by: str | list[str] | None = None, na: str = "raise", precision: str = "double", custom_fit: Callable | None = None) -> Smoothed:
        """Smooth every series of ``df``; ``precision="float"`` gives single-precision columns."""
        keys = _list(partition_by)
        rows = grouped.fit_groups(df, keys, _list(x), y, self.config, _list(order_by) or None, na, custom_fit=custom_fit)
        if precision == "float":
            rows = rows.withColumns({k: F.col(k).cast("float") for k in grouped.point_fields(self.config)})
        return Smoothed(rows, keys, self.config)

    def fit_large(self, df: DataFrame, x: str, y: str) -> DataFrame:
        """Smooth one series of any length with distinct x: x, y, y_smooth, rob_weight."""
        return surface.fit_surface(df, x, y, self.config)

    def predict(self, train: DataFrame, queries: DataFrame, x: str | list[str], y: str, partition_by: str | list[str]) -> DataFrame:
        """Direct fits at the points of ``queries``."""
        return grouped.predict_groups(train, queries, _list(partition_by), _list(x), y, self.config)

    def cross_validate(self, df: DataFrame, x: str | list[str], y: str, partition_by: str | list[str]) -> DataFrame:
        """Score of every candidate span of every series."""
        return grouped.cross_validate_groups(df, _list(partition_by), _list(x), y, self.config)

    def smooth_chunks(self, df: DataFrame, x: str | list[str], y: str, partition_by: str | list[str], order_by: str | list[str] | None = None) -> DataFrame:
        return chunks.fit_chunks(df, _list(partition_by), _list(x), y, self.config, _list(order_by) or None)

    def smooth_online(self, df: DataFrame, x: str | list[str], y: str, partition_by: str | list[str], order_by: str | list[str] | None = None) -> DataFrame:
        return online.fit_online(df, _list(partition_by), _list(x), y, self.config, _list(order_by) or None)

    def stream_chunks(self, df: DataFrame, key: str, x: str | list[str], y: str, order_by: str, end: str | None = None, timeout_ms: int | None = None, reset: str | None = None) -> DataFrame:
        return stateful.chunk_stream(df, key, _list(x), y, self.config, order_by, end, timeout_ms, reset)

    def stream_online(self, df: DataFrame, key: str, x: str | list[str], y: str, order_by: str, reset: str | None = None) -> DataFrame:
        return stateful.online_stream(df, key, _list(x), y, self.config, order_by, reset)


class SmootherBuilder:
    """Chainable options; setting one twice is an error when the smoother is built (switches excepted)."""

    _SWITCHES = ("return_se", "return_diagnostics", "return_residuals", "return_robustness_weights")

    def __init__(self) -> None:
        self._options: dict[str, Any] = {}
        self._twice: list[str] = []

    def set(self, **options: Any) -> SmootherBuilder:
        for name, value in options.items():
            if name in self._options and name not in self._SWITCHES:
                self._twice.append(name)
            self._options[name] = value
        return self

    def confidence_intervals(self, level: float) -> SmootherBuilder:
        return self._interval("confidence_level", level)

    def prediction_intervals(self, level: float) -> SmootherBuilder:
        return self._interval("prediction_level", level)

    def _interval(self, name: str, level: float) -> SmootherBuilder:
        self.set(**{name: level})
        for other in ("confidence_level", "prediction_level"):  # one shared level: the last call wins
            if other in self._options:
                self._options[other] = level
        return self

    def cross_validate(self, fractions: list[float], folds: int | None = 5, seed: int | None = None) -> SmootherBuilder:
        return self.set(cross_validation=CrossValidation(tuple(fractions), folds, seed))

    def build(self, adapter: str = "batch") -> Smoother:
        if self._twice:
            raise E.DuplicateParameter(f"{self._twice[0]} was set more than once")
        return Smoother(SmootherConfig(adapter=adapter, **self._options))


def register_smooth(spark: SparkSession, name: str = "smooth", **options: Any) -> None:
    """A table function for SQL: ``SELECT * FROM smooth(TABLE (SELECT k, x, y ...) PARTITION BY k ORDER BY x)``.

    Its input has the columns key, x and y in this order; its output key (as text), x, y and y_smooth.
    """
    from pyspark.sql.functions import udtf

    config = SmootherConfig(**options)

    class Smooth:
        def __init__(self) -> None:
            self.rows: list[tuple] = []

        def eval(self, row) -> None:
            self.rows.append((row[0], float(row[1]), float(row[2])))

        def terminate(self):
            if self.rows:
                fit = fit_series([r[1] for r in self.rows], [r[2] for r in self.rows], config)
                for (key, x, y), value in zip(self.rows, fit.y.tolist(), strict=True):
                    yield str(key), x, y, value

    spark.udtf.register(name, udtf(Smooth, returnType="key string, x double, y double, y_smooth double"))


def format_result(fit: Smoothed, x: str, y: str, rows: int = 20) -> str:
    """Summary and a table of a single series; the first and last rows if there are more than ``rows``."""
    total = fit.points.count()
    half = rows // 2
    if total > rows:
        top = fit.points.orderBy(x).limit(half).collect()
        shown = [*top, None, *reversed(fit.points.orderBy(F.desc(x)).limit(rows - half).collect())]
    else:
        shown = fit.points.orderBy(x).collect()
    names = [x, y, *grouped.point_fields(fit.config)]
    facts = fit.summary.first()
    lines = ["Summary:", f"  Data points: {total}", *(f"  {k}: {facts[k]}" for k in facts.asDict()), "", "  ".join(f"{n:>12}" for n in names)]
    lines += ["..." if r is None else "  ".join(f"{r[n]:>12.5f}" for n in names) for r in shown]
    return "\n".join(lines)
