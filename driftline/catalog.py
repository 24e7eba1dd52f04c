"""The registered queries, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftline.api import Smoothed, Smoother
from driftline.config import CrossValidation, SmootherConfig
from driftline.functions import columns as C
from driftline.operators import chunks, grouped, online
from driftline.plans import direct
from driftline.plans.padding import pad_series
from driftline.sources.intermediate import shared_folder
from driftline.sources.tables import brand_prices, daily_revenue, read_table, user_activity
from driftline.streaming import stateful

Query = Callable[[SparkSession, str], DataFrame]

FLAGSHIP = "fit_linear_direct"
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: Span of the direct fits below.
SPAN = 0.3


def _add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


def _r(c: Column | str, name: str, digits: int = 6) -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)).alias(name)


# --- kernels and distances ---------------------------------------------------------------------------

_U = "(value / 100)"
_KERNEL_SQL = {
    "cosine": "cos(pi() / 2 * u)",
    "epanechnikov": "1 - u * u",
    "biweight": "(1 - u * u) * (1 - u * u)",
    "triangle": "1 - u",
    "tricube": "(1 - u * u * u) * (1 - u * u * u) * (1 - u * u * u)",
    "uniform": "1.0",
}


def _kernel_sql(name: str, u: str) -> str:
    if name == "gaussian":
        return f"CASE WHEN abs({u}) > 6 THEN 2.2250738585072014e-308 ELSE greatest(exp(-{u} * {u} / 2), 2.2250738585072014e-308) END"
    return f"CASE WHEN abs({u}) < 1 THEN {_KERNEL_SQL[name].replace('u', 'U').replace('U', f'abs({u})') if name not in ('cosine', 'uniform') else _KERNEL_SQL[name].replace('* u', f'* abs({u})')} ELSE 0.0 END"


for _k in ("cosine", "epanechnikov", "gaussian", "biweight", "triangle", "tricube", "uniform"):
    _add(
        f"kernel_{_k}",
        lambda spark, d, k=_k: read_table(spark, d, "events", "event_id", "value").select("event_id", _r(C.kernel(k, F.col("value") / 100), "weight")),
        f"SELECT event_id, round(CAST({_kernel_sql(_k, _U)} AS DOUBLE), 6) + 0.0 AS weight FROM events",
    )

_PROPERTIES_SQL = """
WITH k(kernel, integrator, variance, roughness) AS (VALUES
 ('cosine', 4 / pi(), 4 / pi() - 32 / pow(pi(), 3), 1.0), ('epanechnikov', 4.0 / 3, 4.0 / 15, 16.0 / 15), ('gaussian', sqrt(2 * pi()), sqrt(2 * pi()), sqrt(pi())),
 ('biweight', 16.0 / 15, 16.0 / 105, 256.0 / 315), ('triangle', 1.0, 1.0 / 6, 2.0 / 3), ('tricube', 81.0 / 70, 1.0 / 6, 6561.0 / 6916), ('uniform', 2.0, 2.0 / 3, 2.0)),
e AS (SELECT integrator AS c, variance AS v, roughness AS r FROM k WHERE kernel = 'epanechnikov')
SELECT kernel, round(integrator, 9) AS integrator, round(variance, 9) AS variance, round(roughness, 9) AS roughness,
       round(pow(r / roughness, 0.8) * pow(v / variance, 0.4) * pow(integrator / c, 2), 9) AS efficiency, kernel <> 'gaussian' AS bounded FROM k, e
"""
_add("kernel_properties", lambda spark, d: C.kernel_properties(spark).select("kernel", *(_r(c, c, 9) for c in ("integrator", "variance", "roughness", "efficiency")), "bounded"), _PROPERTIES_SQL)

_LINE = ("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
_ORIGIN = (25.0, 0.05)
_METRIC_SQL = {
    "euclidean": "sqrt(a * a + b * b)",
    "normalized": "sqrt((a * sa) * (a * sa) + (b * sb) * (b * sb))",
    "manhattan": "a + b",
    "chebyshev": "greatest(a, b)",
    "minkowski": "pow(pow(a, 3) + pow(b, 3), 1.0 / 3)",
    "weighted": "sqrt(a * a * 4 + b * b * 1)",
}


def _distance_query(metric: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = read_table(spark, d, "lineitem", *_LINE)
        ranges = rows.agg(*(F.when(F.max(c) > F.min(c), 1 / (F.max(c) - F.min(c))).otherwise(1.0).alias(n) for c, n in (("l_quantity", "sa"), ("l_discount", "sb"))))
        rows = rows.join(F.broadcast(ranges), F.lit(True)) if metric == "normalized" else rows  # one row
        d2 = C.distance(metric, ["l_quantity", "l_discount"], list(_ORIGIN), ["sa", "sb"], 3.0, [4.0, 1.0])
        return rows.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), _r(d2, "distance"))

    return query


for _m, _sql in _METRIC_SQL.items():
    _add(
        f"dist_{_m}",
        _distance_query(_m),
        f"WITH r AS (SELECT 1 / (max(l_quantity) - min(l_quantity)) AS sa, 1 / (max(l_discount) - min(l_discount)) AS sb FROM lineitem), t AS (SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, abs(l_discount - 0.05) AS b, sa, sb FROM lineitem, r) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round({_sql}, 6) + 0.0 AS distance FROM t",
    )

_ARRAY_SQL = {
    "euclidean": "sqrt(list_sum([g * g for g in gaps]))",
    "manhattan": "list_sum(gaps)",
    "chebyshev": "list_max(gaps)",
    "minkowski": "pow(list_sum([pow(g, 3) for g in gaps]), 1.0 / 3)",
}


def _array_query(metric: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = read_table(spark, d, "embeddings", "vec_id", "embedding")
        probe = rows.filter("vec_id = 0").select(F.col("embedding").alias("probe"))
        return rows.join(F.broadcast(probe), F.lit(True)).select("vec_id", _r(C.array_distance(metric, "embedding", "probe", 3.0), "distance", 5))

    return query


for _m, _sql in _ARRAY_SQL.items():
    _add(
        f"dist_array_{_m}",
        _array_query(_m),
        f"WITH p AS (SELECT embedding AS probe FROM embeddings WHERE vec_id = 0), t AS (SELECT vec_id, [abs(CAST(embedding[i] AS DOUBLE) - CAST(probe[i] AS DOUBLE)) for i in range(1, len(embedding) + 1)] AS gaps FROM embeddings, p) SELECT vec_id, round({_sql}, 5) + 0.0 AS distance FROM t",
    )

# --- series, spans, neighbourhoods -------------------------------------------------------------------

_SERIES = f"""s0 AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS x, value AS y, count(*) OVER (PARTITION BY user_id) AS n FROM events),
s AS (SELECT *, greatest(2, least(n, CAST(floor(n * {SPAN} + 1e-5) AS BIGINT))) AS q FROM s0)"""
_NEAR = """near AS (SELECT * FROM (SELECT a.user_id, a.x AS qx, b.x, b.y, b.n, b.q, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.user_id, a.x ORDER BY abs(b.x - a.x), b.x) AS nth
  FROM s a JOIN s b ON a.user_id = b.user_id AND abs(a.x - b.x) < b.q) WHERE nth <= q)"""


def _weights(kernel: str = "tricube") -> str:
    return f"w AS (SELECT *, {_kernel_sql(kernel, '(d / r)')} AS w FROM (SELECT *, max(d) OVER (PARTITION BY user_id, qx) AS r FROM near))"


_MOMENTS = "m AS (SELECT user_id, qx, avg(y) AS plain, sum(w) AS s0, sum(w * (x - qx)) AS s1, sum(w * pow(x - qx, 2)) AS s2, sum(w * pow(x - qx, 3)) AS s3, sum(w * pow(x - qx, 4)) AS s4, sum(w * y) AS t0, sum(w * (x - qx) * y) AS t1, sum(w * pow(x - qx, 2) * y) AS t2 FROM w GROUP BY user_id, qx)"
_VALUE = {
    0: "t0 / s0",
    1: "CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 * s0 * s2 THEN (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) ELSE t0 / s0 END",
    2: "(t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))",
}
_LEVER = "CASE WHEN abs(s0 * s2 - s1 * s1) > 1e-12 * s0 * s2 THEN s2 / (s0 * s2 - s1 * s1) ELSE 1 / s0 END"
_DIRECT = f"WITH {_SERIES}, {_NEAR}, {_weights()}, {_MOMENTS}, f AS (SELECT m.user_id, m.qx AS x, s.y, s.n, {_VALUE[1]} AS fit, {_LEVER} AS leverage FROM m JOIN s ON m.user_id = s.user_id AND m.qx = s.x)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return direct.with_span(user_activity(spark, d), SPAN)


_add("span_size", lambda spark, d: _series(spark, d).groupBy("user_id").agg(F.max("n").alias("n"), F.max("q").alias("q")), f"WITH {_SERIES} SELECT user_id, max(n) AS n, max(q) AS q FROM s GROUP BY user_id")
_add(
    "rank_window",
    lambda spark, d: _series(spark, d).withColumn("i", F.col("x").cast("long") - 1).withColumn("left", F.greatest(F.lit(0), F.least(F.col("i") - F.floor(F.col("q") / 2), F.col("n") - F.col("q")))).select("user_id", "i", "left", (F.col("left") + F.col("q") - 1).alias("right")),
    f'WITH {_SERIES}, t AS (SELECT user_id, CAST(x AS BIGINT) - 1 AS i, n, q FROM s) SELECT user_id, i, greatest(0, least(i - q // 2, n - q)) AS "left", greatest(0, least(i - q // 2, n - q)) + q - 1 AS "right" FROM t',
)


def _knn(exclude_self: bool) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        near = direct.neighbours(_series(spark, d), "user_id", exclude_self=exclude_self)
        nth = F.row_number().over(Window.partitionBy("user_id", "qx").orderBy("d", "x"))
        return near.withColumn("nth", nth.cast("long")).filter("nth <= 5").select("user_id", F.col("qx").alias("x"), "nth", F.col("x").alias("neighbour"), "d")

    return query


for _name, _skip in (("knn_neighborhood", False), ("knn_exclude_self", True)):
    _add(_name, _knn(_skip), f"WITH {_SERIES}, {_NEAR}, t AS (SELECT user_id, qx, x, d, row_number() OVER (PARTITION BY user_id, qx ORDER BY d, x) AS nth FROM near {'WHERE d > 0' if _skip else ''}) SELECT user_id, qx AS x, nth, x AS neighbour, d FROM t WHERE nth <= 5")

# --- direct fits -------------------------------------------------------------------------------------

for _deg, _name in ((0, "fit_constant_direct"), (1, "fit_linear_direct"), (2, "fit_quadratic_direct")):
    _add(
        _name,
        lambda spark, d, deg=_deg: direct.fit_direct(_series(spark, d), "user_id", deg).select("user_id", F.col("qx").alias("x"), _r("fit", "y_smooth")),
        f"WITH {_SERIES}, {_NEAR}, {_weights()}, {_MOMENTS} SELECT user_id, qx AS x, round({_VALUE[_deg]}, 6) + 0.0 AS y_smooth FROM m",
    )
for _k in ("epanechnikov", "gaussian", "uniform"):
    _add(
        f"fit_linear_{_k}",
        lambda spark, d, k=_k: direct.fit_direct(_series(spark, d), "user_id", 1, k).select("user_id", F.col("qx").alias("x"), _r("fit", "y_smooth")),
        f"WITH {_SERIES}, {_NEAR}, {_weights(_k)}, {_MOMENTS} SELECT user_id, qx AS x, round({_VALUE[1]}, 6) + 0.0 AS y_smooth FROM m",
    )


def _predict(spark: SparkSession, d: str) -> DataFrame:
    """Fits half way between neighbouring points."""
    s = _series(spark, d)
    at = s.filter("x < n").select("user_id", (F.col("x") + 0.25).alias("qx"))
    return direct.fit_direct(s, "user_id", 1, at=at).select("user_id", F.col("qx").alias("x"), _r("fit", "y_smooth"))


_add(
    "predict_out_of_sample",
    _predict,
    f"""WITH {_SERIES}, near AS (SELECT * FROM (SELECT a.user_id, a.x + 0.25 AS qx, b.x, b.y, b.q, abs(b.x - a.x - 0.25) AS d, row_number() OVER (PARTITION BY a.user_id, a.x ORDER BY abs(b.x - a.x - 0.25), b.x) AS nth
    FROM s a JOIN s b ON a.user_id = b.user_id AND abs(a.x - b.x) <= b.q WHERE a.x < a.n) WHERE nth <= q), {_weights()}, {_MOMENTS} SELECT user_id, qx AS x, round({_VALUE[1]}, 6) + 0.0 AS y_smooth FROM m""",
)

# --- two predictors: the normal equations of a plane -------------------------------------------------


def _plane(spark: SparkSession, d: str) -> DataFrame:
    """Plane of price on quantity and tax at (25, 0.04), by return flag, through all lines weighted by their distance."""
    rows = read_table(spark, d, "lineitem", "l_returnflag", "l_quantity", "l_tax", "l_extendedprice").select("l_returnflag", F.col("l_quantity").cast("double").alias("a"), (F.col("l_tax") * 100).cast("double").alias("b"), F.col("l_extendedprice").cast("double").alias("y"))
    config = SmootherConfig(dimensions=2, fraction=1.0, surface_mode="direct", distance_metric="weighted", metric_weights=_PLANE_WEIGHTS)
    asked = rows.select("l_returnflag").distinct().select("l_returnflag", F.lit(25.0).alias("a"), F.lit(4.0).alias("b"))
    return Smoother(config).predict(rows, asked, ["a", "b"], "y", "l_returnflag").select("l_returnflag", _r("y_smooth", "y_smooth", 3))


_PLANE_WEIGHTS = (1 / 625, 1 / 16)
_PLANE = "(t0 * (s11 * s22 - s12 * s12) - s01 * (t1 * s22 - s12 * t2) + s02 * (t1 * s12 - s11 * t2)) / (s00 * (s11 * s22 - s12 * s12) - s01 * (s01 * s22 - s12 * s02) + s02 * (s01 * s12 - s11 * s02))"
_add(
    "fit_plane_2d",
    _plane,
    f"""WITH e AS (SELECT l_returnflag, l_quantity - 25 AS a, l_tax * 100 - 4 AS b, l_extendedprice AS y, sqrt(pow((l_quantity - 25) / 25, 2) + pow((l_tax * 100 - 4) / 4, 2)) AS d FROM lineitem),
    g AS (SELECT *, d / max(d) OVER (PARTITION BY l_returnflag) AS u FROM e),
    w AS (SELECT *, {_kernel_sql('tricube', 'u')} AS w FROM g),
    m AS (SELECT l_returnflag, sum(w) AS s00, sum(w * a) AS s01, sum(w * b) AS s02, sum(w * a * a) AS s11, sum(w * a * b) AS s12, sum(w * b * b) AS s22, sum(w * y) AS t0, sum(w * a * y) AS t1, sum(w * b * y) AS t2 FROM w GROUP BY l_returnflag)
    SELECT l_returnflag, round({_PLANE}, 3) + 0.0 AS y_smooth FROM m""",
)

# --- padding -----------------------------------------------------------------------------------------

_PAD = f"WITH {_SERIES}, k AS (SELECT *, least(q // 2, n - 1) AS k FROM s), own AS (SELECT user_id, x, y, CAST(x AS BIGINT) AS source FROM s), i AS (SELECT unnest(range(1, 1000)) AS i)"
_PAD_SQL = {
    "extend": "SELECT user_id, x - i AS x, y, 1 AS source FROM k, i WHERE x = 1 AND i <= k UNION ALL SELECT user_id, x + i, y, n FROM k, i WHERE x = n AND i <= k",
    "zero": "SELECT user_id, x - i AS x, 0.0 AS y, 1 AS source FROM k, i WHERE x = 1 AND i <= k UNION ALL SELECT user_id, x + i, 0.0, n FROM k, i WHERE x = n AND i <= k",
    "reflect": "SELECT user_id, 2 - x AS x, y, 1 AS source FROM k WHERE x > 1 AND x <= k + 1 UNION ALL SELECT user_id, 2 * n - x, y, n FROM k WHERE x < n AND x >= n - k",
}
for _p, _sql in _PAD_SQL.items():
    _add(
        f"pad_{_p}",
        lambda spark, d, p=_p: pad_series(_series(spark, d), "user_id", p).select("user_id", "x", _r("y", "y"), "source"),
        f"{_PAD} SELECT user_id, CAST(x AS DOUBLE) AS x, round(y, 6) + 0.0 AS y, CAST(source AS BIGINT) AS source FROM (SELECT * FROM own UNION ALL {_sql})",
    )

# --- robustness --------------------------------------------------------------------------------------

_RES = "r AS (SELECT user_id, event_id, abs(value - avg(value) OVER (PARTITION BY user_id)) AS r FROM events), m AS (SELECT user_id, median(r) AS med, avg(r) AS mean FROM r GROUP BY user_id), d AS (SELECT r.user_id, median(abs(r - med)) AS spread, max(mean) AS mean FROM r JOIN m USING (user_id) GROUP BY r.user_id)"


def _guard(s: str) -> str:
    return f"CASE WHEN mean = 0 THEN 0.0 WHEN {s} <= greatest(1e-7 * mean, 1e-12) THEN greatest(mean, {s}) ELSE {s} END"


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "events", "user_id", "event_id", "value")
    return rows.select("user_id", "event_id", F.abs(F.col("value") - F.avg("value").over(Window.partitionBy("user_id"))).alias("r"))


_add("scale_mar", lambda spark, d: direct.robust_scales(_residuals(spark, d), "user_id", "mar").select("user_id", _r("scale", "scale")), f"WITH {_RES} SELECT user_id, round({_guard('med')}, 6) AS scale FROM m")
_add("scale_mad", lambda spark, d: direct.robust_scales(_residuals(spark, d), "user_id", "mad").select("user_id", _r("scale", "scale")), f"WITH {_RES} SELECT user_id, round({_guard('spread')}, 6) AS scale FROM d")
_WEIGHT_SQL = {
    "bisquare": "CASE WHEN s <= 0 THEN 1.0 WHEN r / greatest(6 * s, 1e-12) <= 0.001 THEN 1.0 WHEN r / greatest(6 * s, 1e-12) >= 0.999 THEN 0.0 ELSE pow(1 - pow(r / greatest(6 * s, 1e-12), 2), 2) END",
    "huber": "CASE WHEN s <= 0 THEN 1.0 WHEN r / s <= 1.345 THEN 1.0 ELSE 1.345 / (r / s) END",
    "talwar": "CASE WHEN s <= 0 THEN 1.0 WHEN r / s <= 2.5 THEN 1.0 ELSE 0.0 END",
}


def _weight_query(method: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        r = _residuals(spark, d)
        return r.join(direct.robust_scales(r, "user_id"), "user_id").select("event_id", _r(C.robustness_weight(method, "r", "scale"), "weight"))

    return query


for _m, _sql in _WEIGHT_SQL.items():
    _add(f"weights_{_m}", _weight_query(_m), f"WITH {_RES}, t AS (SELECT event_id, r, {_guard('d.spread').replace('mean', 'd.mean')} AS s FROM r JOIN d ON r.user_id = d.user_id) SELECT event_id, round(CAST({_sql} AS DOUBLE), 6) + 0.0 AS weight FROM t")

_ROBUST = f"""{_DIRECT}, a AS (SELECT *, abs(y - fit) AS r FROM f), am AS (SELECT user_id, median(r) AS med, avg(r) AS mean FROM a GROUP BY user_id),
ad AS (SELECT a.user_id, median(abs(r - med)) AS spread, max(mean) AS mean FROM a JOIN am USING (user_id) GROUP BY a.user_id),
rw AS (SELECT a.user_id, a.x, {_WEIGHT_SQL['bisquare'].replace('s <= 0', 'sc <= 0').replace('* s', '* sc')} AS rw FROM (SELECT a.*, {_guard('ad.spread').replace('mean', 'ad.mean')} AS sc FROM a JOIN ad ON a.user_id = ad.user_id) a),
w2 AS (SELECT w.user_id, w.qx, w.x, w.y, w.w * rw.rw AS w FROM w JOIN rw ON w.user_id = rw.user_id AND w.x = rw.x),
{_MOMENTS.replace('m AS', 'm2 AS').replace('FROM w ', 'FROM w2 ')}"""
_add(
    "robust_fit_direct",
    lambda spark, d: direct.fit_robust(_series(spark, d), "user_id").select("user_id", "x", _r("fit", "y_smooth", 5), _r("rw", "rob_weight", 5)),
    f"{_ROBUST} SELECT m2.user_id, m2.qx AS x, round(CASE WHEN s0 <= 2.220446049250313e-16 THEN plain ELSE {_VALUE[1]} END, 5) + 0.0 AS y_smooth, round(rw.rw, 5) + 0.0 AS rob_weight FROM m2 JOIN rw ON m2.user_id = rw.user_id AND m2.qx = rw.x",
)

# --- errors, intervals, diagnostics ------------------------------------------------------------------


#: One direct pass without artificial points, with all that the engine says of a fit.
_PLAIN = {"fraction": SPAN, "iterations": 1, "surface_mode": "direct", "boundary_policy": "none"}
_LEVEL = 0.95
_ENGINE = SmootherConfig(**_PLAIN, confidence_level=_LEVEL, prediction_level=_LEVEL, return_diagnostics=True)


def _engine(spark: SparkSession, d: str) -> Smoothed:
    return Smoother(_ENGINE).fit(user_activity(spark, d).drop("n"), "x", "y", "user_id")


_HAT_TAIL = """o AS (SELECT *, abs(y - fit) AS r, row_number() OVER (PARTITION BY user_id ORDER BY abs(y - fit)) AS nth FROM f),
h0 AS (SELECT user_id, max(n) AS n, sum(leverage) AS trace_hat, sum(leverage * leverage) AS l2, sum(r * r) AS rss, max(CASE WHEN nth = n // 2 + 1 THEN r END) AS mid FROM o GROUP BY user_id),
h1 AS (SELECT *, n - 2 * trace_hat + l2 AS delta1 FROM h0), h AS (SELECT *, delta1 * delta1 / n AS delta2, CASE WHEN delta1 > 0 THEN sqrt(rss / delta1) ELSE 0.0 END AS residual_scale, 1.4826 * mid AS sigma FROM h1)"""
_HAT = f"{_DIRECT}, {_HAT_TAIL}"
_add("hat_statistics", lambda spark, d: _engine(spark, d).summary.select("user_id", *(_r(c, c) for c in ("trace_hat", "delta1", "delta2", "residual_scale"))), f"{_HAT} SELECT user_id, round(trace_hat, 6) AS trace_hat, round(delta1, 6) AS delta1, round(delta2, 6) AS delta2, round(residual_scale, 6) AS residual_scale FROM h")
#: Fixed value: the usual rounded normal quantile of 95 percent.
_Z = 1.96


_add(
    "intervals_direct",
    lambda spark, d: _engine(spark, d).points.select("user_id", "x", *(_r(c, c) for c in ("std_err", "conf_lower", "conf_upper", "pred_lower", "pred_upper"))),
    f"""{_HAT}, t AS (SELECT f.user_id, f.x, f.fit, sigma * sqrt(leverage) AS se, residual_scale AS sd, CASE WHEN delta1 * delta1 / delta2 > 2 THEN {_Z} * sqrt((delta1 * delta1 / delta2) / (delta1 * delta1 / delta2 - 2)) ELSE 1.5 * {_Z} END AS t FROM f JOIN h ON f.user_id = h.user_id)
    SELECT user_id, x, round(se, 6) + 0.0 AS std_err, round(fit - t * se, 6) + 0.0 AS conf_lower, round(fit + t * se, 6) + 0.0 AS conf_upper, round(fit - t * sqrt(se * se + sd * sd), 6) + 0.0 AS pred_lower, round(fit + t * sqrt(se * se + sd * sd), 6) + 0.0 AS pred_upper FROM t""",
)


_add(
    "diagnostics",
    lambda spark, d: _engine(spark, d).summary.select("user_id", *(_r(f"diagnostics.{c}", c) for c in ("rmse", "mae", "r_squared", "residual_sd", "effective_df")), *(_r(f"diagnostics.{c}", c, 4) for c in ("aic", "aicc"))),
    f"""{_HAT}, a AS (SELECT f.*, y - fit AS r, avg(y) OVER (PARTITION BY f.user_id) AS mean, sigma * sqrt(leverage) AS se FROM f JOIN h ON f.user_id = h.user_id), am AS (SELECT user_id, median(r) AS med FROM a GROUP BY user_id),
    ad AS (SELECT a.user_id, median(abs(r - med)) AS mad FROM a JOIN am ON a.user_id = am.user_id GROUP BY a.user_id),
    t AS (SELECT a.user_id, count(*) AS n, sum(r * r) AS rss, avg(abs(r)) AS mae, sum((y - mean) * (y - mean)) AS tss, max(1.4826 * CASE WHEN mad > 0 THEN mad ELSE 1e-12 END) AS sd, sum(least(1.0, pow(se / (1.4826 * CASE WHEN mad > 0 THEN mad ELSE 1e-12 END), 2))) AS df FROM a JOIN ad ON a.user_id = ad.user_id GROUP BY a.user_id)
    SELECT user_id, round(sqrt(rss / n), 6) AS rmse, round(mae, 6) AS mae, round(1 - rss / tss, 6) + 0.0 AS r_squared, round(sd, 6) AS residual_sd, round(df, 6) AS effective_df, round(n * ln(rss / n) + 2 * df, 4) AS aic, round(n * ln(rss / n) + 2 * df + 2 * df * (df + 1) / (n - df - 1), 4) AS aicc FROM t""",
)

# --- chunks and online -------------------------------------------------------------------------------

_CHUNK, _OVERLAP, _CHUNK_SPAN = 20, 6, 0.5


def _chunk_config(strategy: str) -> SmootherConfig:
    return SmootherConfig(adapter="streaming", fraction=_CHUNK_SPAN, iterations=1, surface_mode="direct", boundary_policy="none", chunk_size=_CHUNK, overlap=_OVERLAP, merge_strategy=strategy)


def _chunked(spark: SparkSession, d: str, strategy: str) -> DataFrame:
    return chunks.fit_chunks(user_activity(spark, d).drop("n"), ["user_id"], ["x"], "y", _chunk_config(strategy))


_MERGE_SQL = {"average": "(p + c) / 2", "weighted_average": f"p * (1 - place / {_OVERLAP}.0) + c * (place / {_OVERLAP}.0)", "take_first": "p", "take_last": "c"}
_BLOCKS = f"""WITH s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS row, count(*) OVER (PARTITION BY user_id) AS n FROM events),
l AS (SELECT *, greatest(0, (n - 1) // {_CHUNK} - CASE WHEN (n - 1) % {_CHUNK} + 1 < {_OVERLAP} THEN 1 ELSE 0 END) AS last FROM s),
o AS (SELECT *, least(row // {_CHUNK}, last) AS own FROM l),
b AS (SELECT user_id, x, y, row, own, own AS block FROM o UNION ALL SELECT user_id, x, y, row, own, own + 1 FROM o WHERE own < last AND (own + 1) * {_CHUNK} - row <= {_OVERLAP}),
z AS (SELECT *, count(*) OVER (PARTITION BY user_id, block) AS m FROM b), zz AS (SELECT *, greatest(2, least(m, CAST(floor(m * {_CHUNK_SPAN} + 1e-5) AS BIGINT))) AS q FROM z),
near AS (SELECT * FROM (SELECT a.user_id, a.block, a.own, a.row, a.x AS qx, a.y AS qy, b.x, b.y, b.q, abs(b.x - a.x) AS d, row_number() OVER (PARTITION BY a.user_id, a.block, a.x ORDER BY abs(b.x - a.x), b.x) AS nth FROM zz a JOIN zz b ON a.user_id = b.user_id AND a.block = b.block) WHERE nth <= q),
w AS (SELECT *, {_kernel_sql('tricube', '(d / r)')} AS w FROM (SELECT *, max(d) OVER (PARTITION BY user_id, block, qx) AS r FROM near)),
m AS (SELECT user_id, block, own, row, qx, max(qy) AS qy, sum(w) AS s0, sum(w * (x - qx)) AS s1, sum(w * pow(x - qx, 2)) AS s2, sum(w * y) AS t0, sum(w * (x - qx) * y) AS t1 FROM w GROUP BY ALL),
f AS (SELECT user_id, row, qx AS x, max(qy) AS y, max(block) AS chunk, {_OVERLAP} - ((max(own) + 1) * {_CHUNK} - row) AS place, max(CASE WHEN block = own THEN fit END) AS p, max(CASE WHEN block > own THEN fit END) AS c FROM (SELECT *, {_VALUE[1]} AS fit FROM m) GROUP BY user_id, row, qx)"""
for _s, _sql in _MERGE_SQL.items():
    _add(
        f"chunk_merge_{_s}",
        lambda spark, d, s=_s: _chunked(spark, d, s).select("user_id", "x", F.col("chunk").cast("long").alias("chunk"), _r("y_smooth", "y_smooth", 5)),
        f"{_BLOCKS} SELECT user_id, x, CAST(chunk AS BIGINT) AS chunk, round(CASE WHEN c IS NULL THEN p ELSE {_sql} END, 5) + 0.0 AS y_smooth FROM f",
    )
_add(
    "diagnostics_streaming",
    lambda spark, d: chunks.cumulative_diagnostics(_chunked(spark, d, "average"), ["user_id"], "y").select("user_id", F.col("chunk").cast("long").alias("chunk"), *(_r(c, c, 5) for c in ("rmse", "mae", "r_squared", "residual_sd"))),
    f"""{_BLOCKS}, e AS (SELECT user_id, chunk, y, y - CASE WHEN c IS NULL THEN p ELSE (p + c) / 2 END AS r FROM f), g AS (SELECT user_id, chunk, count(*) AS n, sum(y) AS sy, sum(y * y) AS syy, sum(r) AS sr, sum(r * r) AS srr, sum(abs(r)) AS sa FROM e GROUP BY user_id, chunk),
    u AS (SELECT user_id, chunk, sum(n) OVER o AS n, sum(sy) OVER o AS sy, sum(syy) OVER o AS syy, sum(sr) OVER o AS sr, sum(srr) OVER o AS srr, sum(sa) OVER o AS sa FROM g WINDOW o AS (PARTITION BY user_id ORDER BY chunk))
    SELECT user_id, CAST(chunk AS BIGINT) AS chunk, round(sqrt(srr / n), 5) AS rmse, round(sa / n, 5) AS mae, round(1 - srr / (syy - sy * sy / n), 5) + 0.0 AS r_squared, round(sqrt((srr - sr * sr / n) / (n - 1)), 5) AS residual_sd FROM u""",
)
_CAPACITY, _ONLINE_SPAN = 15, 0.6
_ONLINE = SmootherConfig(adapter="online", fraction=_ONLINE_SPAN, surface_mode="direct", boundary_policy="none", window_capacity=_CAPACITY, min_points=3)
_add(
    "online_incremental",
    lambda spark, d: online.fit_online(user_activity(spark, d).drop("n"), ["user_id"], ["x"], "y", _ONLINE).select("user_id", "x", _r("y_smooth", "y_smooth", 5), _r("residual", "residual", 5)),
    f"""WITH s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS x, value AS y FROM events), t AS (SELECT *, least(x, {_CAPACITY}) AS n FROM s),
    z AS (SELECT *, greatest(2, least(n, floor(n * {_ONLINE_SPAN} + 1e-5))) AS q FROM t),
    near AS (SELECT a.user_id, a.x AS qx, b.x, b.y, a.x - b.x AS d, max(a.x - b.x) OVER (PARTITION BY a.user_id, a.x) AS r FROM z a JOIN z b ON a.user_id = b.user_id AND b.x <= a.x AND b.x > a.x - a.q WHERE a.n >= 3),
    w AS (SELECT *, {_kernel_sql('tricube', '(d / r)')} AS w FROM near), m AS (SELECT user_id, qx, sum(w) AS s0, sum(w * (x - qx)) AS s1, sum(w * pow(x - qx, 2)) AS s2, sum(w * y) AS t0, sum(w * (x - qx) * y) AS t1 FROM w GROUP BY user_id, qx),
    f AS (SELECT user_id, qx AS x, {_VALUE[1]} AS fit FROM m)
    SELECT s.user_id, s.x, round(fit, 5) + 0.0 AS y_smooth, round(y - fit, 5) + 0.0 AS residual FROM s LEFT JOIN f ON s.user_id = f.user_id AND s.x = f.x""",
)

# --- whole engine: no SQL form, tested against plain versions ----------------------------------------


def _grouped(options: dict, digits: int = 6) -> Query:
    config = SmootherConfig(**options)

    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = grouped.fit_groups(user_activity(spark, d).drop("n"), ["user_id"], ["x"], "y", config)
        return rows.select("user_id", "x", *(_r(k, k, digits) for k in grouped.point_fields(config)))

    return query


_add("smooth_cubic_direct", _grouped({"degree": 3, "fraction": 0.6, "surface_mode": "direct"}))
_add("smooth_quartic", _grouped({"degree": 4, "fraction": 0.7}))
_add("online_full", lambda spark, d: online.fit_online(user_activity(spark, d).drop("n"), ["user_id"], ["x"], "y", _ONLINE.but(update_mode="full", iterations=3)))


def _two_predictors(spark: SparkSession, d: str) -> DataFrame:
    """Price of each part brand on size and retail rank."""
    part = read_table(spark, d, "part", "p_partkey", "p_brand", "p_size", "p_retailprice").withColumns({"a": F.col("p_size").cast("double"), "b": (F.col("p_partkey") % 97).cast("double")})
    config = SmootherConfig(dimensions=2, fraction=0.6, boundary_policy="reflect")
    return grouped.fit_groups(part, ["p_brand"], ["a", "b"], "p_retailprice", config, ["p_partkey"]).select("p_partkey", "p_brand", _r("y_smooth", "y_smooth"))


_add("smooth_2d", _two_predictors)
_CV = SmootherConfig(iterations=1, cross_validation=CrossValidation((0.3, 0.5, 0.7), 5, 7))
_add("kfold_cv_seeded", lambda spark, d: grouped.cross_validate_groups(brand_prices(spark, d).drop("n"), ["p_brand"], ["x"], "y", _CV).select("p_brand", "fraction", _r("score", "score"), "best"))


def _folds_sql(fractions: tuple[float, ...], folds: int | None) -> str:
    """Scores of direct linear fits to the rows of the other folds, at all places between which the held out rows lie."""
    fold, score = ("x - 1", "sqrt(sum(e) / count(*))") if folds is None else (f"least((x - 1) // (n // {folds}), {folds - 1})", "sqrt(avg(e))")
    total = "SELECT p_brand, fraction, {0} AS score FROM e GROUP BY p_brand, fraction".format(score) if folds is None else f"SELECT p_brand, fraction, avg(s) AS score FROM (SELECT p_brand, fraction, test, {score} AS s FROM e GROUP BY p_brand, fraction, test) GROUP BY p_brand, fraction"
    return f"""WITH s0 AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS x, p_retailprice AS y, count(*) OVER (PARTITION BY p_brand) AS n FROM part),
    s AS (SELECT *, {fold} AS fold FROM s0 WHERE n >= {folds or 3}), tests AS (SELECT DISTINCT p_brand, fold AS test FROM s), f AS (SELECT unnest([{", ".join(map(str, fractions))}]) AS fraction),
    r0 AS (SELECT s.p_brand, test, x, y, row_number() OVER (PARTITION BY s.p_brand, test ORDER BY x) AS k, count(*) OVER (PARTITION BY s.p_brand, test) AS m FROM s JOIN tests t ON s.p_brand = t.p_brand AND fold <> test),
    r AS (SELECT r0.*, fraction, greatest(2, least(m, CAST(floor(m * fraction + 1e-5) AS BIGINT))) AS q FROM r0, f),
    a AS (SELECT s.p_brand, test, s.x AS px, s.y AS py, (SELECT max(x) FROM r0 z WHERE z.p_brand = s.p_brand AND z.test = t.test AND z.x < s.x) AS lo, (SELECT min(x) FROM r0 z WHERE z.p_brand = s.p_brand AND z.test = t.test AND z.x > s.x) AS hi FROM s JOIN tests t ON s.p_brand = t.p_brand AND fold = test),
    ends AS (SELECT DISTINCT p_brand, test, unnest([coalesce(lo, hi), coalesce(hi, lo)]) AS qx FROM a),
    near AS (SELECT * FROM (SELECT e.p_brand, e.test, r.fraction, e.qx, r.x, r.y, r.q, abs(r.x - e.qx) AS d, row_number() OVER (PARTITION BY e.p_brand, e.test, r.fraction, e.qx ORDER BY abs(r.x - e.qx), r.x) AS nth FROM ends e JOIN r ON e.p_brand = r.p_brand AND e.test = r.test) WHERE nth <= q),
    w AS (SELECT *, {_kernel_sql('tricube', '(d / reach)')} AS w FROM (SELECT *, max(d) OVER (PARTITION BY p_brand, test, fraction, qx) AS reach FROM near)),
    m AS (SELECT p_brand, test, fraction, qx, sum(w) AS s0, sum(w * (x - qx)) AS s1, sum(w * pow(x - qx, 2)) AS s2, sum(w * y) AS t0, sum(w * (x - qx) * y) AS t1 FROM w GROUP BY p_brand, test, fraction, qx),
    v AS (SELECT p_brand, test, fraction, qx, {_VALUE[1]} AS fit FROM m),
    e AS (SELECT a.p_brand, a.test, l.fraction, pow(py - CASE WHEN lo IS NULL OR hi IS NULL THEN l.fit ELSE l.fit + (h.fit - l.fit) * (px - lo) / (hi - lo) END, 2) AS e FROM a JOIN v l ON a.p_brand = l.p_brand AND a.test = l.test AND l.qx = coalesce(lo, hi) JOIN v h ON a.p_brand = h.p_brand AND a.test = h.test AND h.qx = coalesce(hi, lo) AND l.fraction = h.fraction),
    scores AS ({total})
    """


_SCORED = "SELECT p_brand, CAST(fraction AS DOUBLE) AS fraction, round(score, 6) + 0.0 AS score"
_BEST = "fraction = min(CASE WHEN score <= least * (1 + 1e-9) THEN fraction END) OVER (PARTITION BY p_brand) AS best FROM (SELECT *, min(score) OVER (PARTITION BY p_brand) AS least FROM scores)"


def _validated(fractions: tuple[float, ...], folds: int | None) -> Query:
    config = SmootherConfig(iterations=1, surface_mode="direct", boundary_policy="none", cross_validation=CrossValidation(fractions, folds))
    return lambda spark, d: Smoother(config).cross_validate(brand_prices(spark, d).filter(F.col("n") >= (folds or 3)).drop("n"), "x", "y", "p_brand").select("p_brand", "fraction", _r("score", "score"), "best")


_add("kfold_cv", _validated((0.4, 0.8), 5), f"{_folds_sql((0.4, 0.8), 5)} {_SCORED}, {_BEST}")
_add("loocv", lambda spark, d: _validated((0.5, 1.0), None)(spark, d).drop("best"), f"{_folds_sql((0.5, 1.0), None)} {_SCORED} FROM scores")


def _best_fraction(spark: SparkSession, d: str) -> DataFrame:
    config = SmootherConfig(iterations=1, surface_mode="direct", boundary_policy="none", cross_validation=CrossValidation((0.4, 0.8), 5))
    fit = Smoother(config).fit(brand_prices(spark, d).filter("n >= 5").drop("n"), "x", "y", "p_brand")
    return fit.summary.select("p_brand", "fraction_used", _r(F.array_min("cv_scores"), "best_cv_score"))  # a join with best_cv_score() would fit twice


_add("best_fraction", _best_fraction, f"{_folds_sql((0.4, 0.8), 5)} SELECT p_brand, fraction AS fraction_used, round(score, 6) + 0.0 AS best_cv_score FROM (SELECT p_brand, CAST(fraction AS DOUBLE) AS fraction, score, {_BEST}) WHERE best")

# --- window standard errors --------------------------------------------------------------------------


_add(
    "window_se",
    lambda spark, d: grouped.window_errors(user_activity(spark, d).drop("n").withColumn("mean", F.avg("y").over(Window.partitionBy("user_id"))), ["user_id"], "x", "y", "mean", SmootherConfig(fraction=SPAN)).select("user_id", "x", _r("std_err", "std_err")),
    f"""WITH {_SERIES}, r AS (SELECT *, y - avg(y) OVER (PARTITION BY user_id) AS r, greatest(0, least(CAST(x AS BIGINT) - 1 - q // 2, n - q)) + 1 AS low FROM s), h AS (SELECT *, low + q - 1 AS high FROM r),
    p AS (SELECT a.user_id, a.x, b.r, abs(b.x - a.x) / greatest(a.x - a.low, a.high - a.x) AS u FROM h a JOIN r b ON a.user_id = b.user_id AND b.x BETWEEN a.low AND a.high), w AS (SELECT *, {_kernel_sql('tricube', 'u')} AS w FROM p),
    m AS (SELECT user_id, x, sum(w) AS sw, sum(w * r * r) AS swr FROM w GROUP BY user_id, x) SELECT user_id, x, round(CASE WHEN sw > 2 THEN sqrt(swr / (sw - 2) / sw) ELSE 0.0 END, 6) + 0.0 AS std_err FROM m""",
)

# --- interpolation surface ---------------------------------------------------------------------------

#: Value and slope at a vertex from its moments, by degree.
_VERTEX = {
    1: (_VALUE[1], "(s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1)"),
    2: (_VALUE[2], "(s0 * (t1 * s4 - s3 * t2) - t0 * (s1 * s4 - s3 * s2) + s2 * (s1 * t2 - t1 * s2)) / (s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2))"),
}
_USERS = "s0 AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS DOUBLE) AS x, value AS y, count(*) OVER (PARTITION BY user_id) AS n FROM events)"
_DAYS = "s0 AS (SELECT 0 AS user_id, x, y, count(*) OVER () AS n FROM (SELECT CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS x, avg(o_totalprice) AS y FROM orders GROUP BY 1))"
_ENDS_SQL = {
    "extend": "SELECT e.user_id, x1 - i * (x2 - x1) AS x, y1 AS y, x1 AS source FROM ends e, i WHERE i <= k UNION ALL SELECT e.user_id, x4 + i * (x4 - x3), y4, x4 FROM ends e, i WHERE i <= k",
    "reflect": "SELECT a.user_id, 2 * x1 - x AS x, y, x1 AS source FROM a JOIN ends e ON a.user_id = e.user_id WHERE pos BETWEEN 1 AND k UNION ALL SELECT a.user_id, 2 * x4 - x, y, x4 FROM a JOIN ends e ON a.user_id = e.user_id WHERE pos BETWEEN a.n - 1 - k AND a.n - 2",
}


#: The cuts of the cells and the ends of the box.
_VERTICES = "SELECT DISTINCT c.user_id, x AS v, false AS outside FROM c JOIN p ON c.user_id = p.user_id AND p.pos = (lo + hi) // 2 WHERE hi - lo + 1 > fc UNION SELECT user_id, low - 0.005 * (high - low), true FROM b UNION SELECT user_id, high + 0.005 * (high - low), true FROM b"


def _surface_sql(series: str, fraction: float, passes: int = 1, degree: int = 1, boundary: str = "extend", method: str = "bisquare", scaling: str = "mad", direct: bool = False) -> str:
    """Common table expressions up to ``e{passes - 1}`` (user_id, x, y, n, fit) and ``rw{passes - 1}``: the interpolation surface, or direct fits at all rows."""
    scale = _guard({"mad": "spread", "mar": "med"}[scaling])
    weight = re.sub(r"\bs\b", "sc", _WEIGHT_SQL[method])
    out = f"""WITH RECURSIVE {series}, a AS MATERIALIZED (SELECT *, greatest(2, least(n, CAST(floor(n * {fraction} + 1e-5) AS BIGINT))) AS q, row_number() OVER (PARTITION BY user_id ORDER BY x) - 1 AS pos FROM s0),
ends AS MATERIALIZED (SELECT user_id, any_value(n) AS n, any_value(q) AS q, least(any_value(q) // 2, any_value(n) - 1) AS k, max(CASE WHEN pos = 0 THEN x END) AS x1, max(CASE WHEN pos = 1 THEN x END) AS x2, max(CASE WHEN pos = n - 2 THEN x END) AS x3, max(CASE WHEN pos = n - 1 THEN x END) AS x4, max(CASE WHEN pos = 0 THEN y END) AS y1, max(CASE WHEN pos = n - 1 THEN y END) AS y4 FROM a GROUP BY user_id),
i AS (SELECT unnest(range(1, 2000)) AS i), p0 AS (SELECT user_id, x, y, x AS source FROM a UNION ALL {_ENDS_SQL[boundary]}), p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) - 1 AS pos FROM p0),
b AS (SELECT p.user_id, max(q) AS q, count(*) AS m, min(x) AS low, max(x) AS high FROM p JOIN ends ON p.user_id = ends.user_id GROUP BY p.user_id),
c AS (SELECT user_id, CAST(0 AS BIGINT) AS lo, m - 1 AS hi, greatest(1, CAST(floor(m * 0.2 * {fraction}) AS BIGINT)) AS fc FROM b
  UNION ALL SELECT user_id, CASE WHEN side = 0 THEN lo ELSE (lo + hi) // 2 + 1 END, CASE WHEN side = 0 THEN (lo + hi) // 2 ELSE hi END, fc FROM c, (SELECT unnest([0, 1]) AS side) WHERE hi - lo + 1 > fc),
v AS MATERIALIZED ({"SELECT user_id, x AS v, false AS outside FROM a" if direct else _VERTICES}),
near AS (SELECT * FROM (SELECT v.user_id, v AS qx, outside, x, y, q, source, abs(x - v) AS d, row_number() OVER (PARTITION BY v.user_id, v ORDER BY abs(x - v), x) AS nth FROM v JOIN p ON v.user_id = p.user_id JOIN b ON v.user_id = b.user_id) WHERE nth <= q),
{_weights().replace("w AS", "wp AS MATERIALIZED", 1)}"""
    for k in range(passes):
        if k:
            out += f""", r{k} AS MATERIALIZED (SELECT user_id, x, abs(y - fit) AS r FROM e{k - 1}), am{k} AS (SELECT user_id, median(r) AS med, avg(r) AS mean FROM r{k} GROUP BY user_id),
ad{k} AS (SELECT r.user_id, median(abs(r - med)) AS spread, max(med) AS med, max(mean) AS mean FROM r{k} r JOIN am{k} a ON r.user_id = a.user_id GROUP BY r.user_id), rw{k} AS MATERIALIZED (SELECT user_id, x, {weight} AS rw FROM (SELECT r.user_id, x, r, {scale} AS sc FROM r{k} r JOIN ad{k} d ON r.user_id = d.user_id))"""
        weighed = f"SELECT wp.* REPLACE (w * rw AS w) FROM wp JOIN rw{k} r ON wp.user_id = r.user_id AND wp.source = r.x" if k else "SELECT * FROM wp"
        value, slope = _VERTEX[degree]
        if degree > 1:  # vertices beyond the data are fitted by lines
            value, slope = (f"CASE WHEN outside THEN {line} ELSE {own} END" for line, own in zip(_VERTEX[1], _VERTEX[degree], strict=True))
        moments = _MOMENTS.replace("m AS", f"m{k} AS", 1).replace("SELECT user_id, qx,", "SELECT user_id, qx, any_value(outside) AS outside,", 1).replace("FROM w GROUP", f"FROM w{k} GROUP", 1)
        out += f""", w{k} AS ({weighed}), {moments}, t{k} AS (SELECT user_id, qx AS v, {value} AS f, {slope} AS g, {_LEVER} AS leverage FROM m{k}),
{_blend_sql(k, direct)}"""
    return out


def _blend_sql(k: int, direct: bool) -> str:
    """``e{k}`` from the vertices ``t{k}``."""
    if direct:
        return f"e{k} AS MATERIALIZED (SELECT s.user_id, s.x, s.y, s.n, f AS fit, leverage FROM a s JOIN t{k} t ON s.user_id = t.user_id AND s.x = t.v)"
    return f"""cells{k} AS (SELECT user_id, v AS a, f AS fa, g AS ga, lead(v) OVER o AS b, lead(f) OVER o AS fb, lead(g) OVER o AS gb FROM t{k} WINDOW o AS (PARTITION BY user_id ORDER BY v)),
h{k} AS (SELECT s.user_id, s.x, s.y, s.n, fa, fb, ga, gb, b - a AS w, (s.x - c.a) / (b - a) AS h FROM a s JOIN cells{k} c ON s.user_id = c.user_id AND s.x > c.a AND s.x <= b),
e{k} AS MATERIALIZED (SELECT user_id, x, y, n, (1 - h) * (1 - h) * (1 + 2 * h) * fa + h * h * (3 - 2 * h) * fb + (h * (1 - h) * (1 - h) * ga + h * h * (h - 1) * gb) * w AS fit FROM h{k})"""


_SIGMA = "u AS (SELECT user_id, max(CASE WHEN nth = n // 2 + 1 THEN r END) AS mid FROM (SELECT user_id, n, abs(y - fit) AS r, row_number() OVER (PARTITION BY user_id ORDER BY abs(y - fit)) AS nth FROM e0) GROUP BY user_id)"
_add(
    "surface_fit_1d",
    _grouped({"fraction": SPAN, "iterations": 1, "return_se": True, "return_residuals": True}, 5),
    f"{_surface_sql(_USERS, SPAN)}, {_SIGMA} SELECT e0.user_id, x, round(fit, 5) + 0.0 AS y_smooth, round(1.4826 * mid * sqrt({SPAN} / n), 5) + 0.0 AS std_err, round(y - fit, 5) + 0.0 AS residual FROM e0 JOIN u ON e0.user_id = u.user_id",
)
_LAST = "SELECT user_id, x, round(fit, 5) + 0.0 AS y_smooth FROM e2"
_add("smooth_default", _grouped({}, 5), f"{_surface_sql(_USERS, 0.67, 3)} {_LAST}")
_add("smooth_quadratic", _grouped({"degree": 2, "fraction": 0.5}, 5), f"{_surface_sql(_USERS, 0.5, 3, 2)} {_LAST}")
_add("smooth_huber_reflect", _grouped({"robustness_method": "huber", "scaling_method": "mar", "boundary_policy": "reflect"}, 5), f"{_surface_sql(_USERS, 0.67, 3, 1, 'reflect', 'huber', 'mar')} {_LAST}")
_add(
    "smooth_intervals",
    _grouped({"surface_mode": "direct", "confidence_level": _LEVEL, "prediction_level": _LEVEL, "return_residuals": True, "return_robustness_weights": True}, 5),
    f"""{_surface_sql(_USERS, 0.67, 3, direct=True)}, f AS (SELECT * FROM e2), {_HAT_TAIL},
    t AS (SELECT f.*, sigma * sqrt(leverage) AS se, residual_scale AS sd, CASE WHEN delta1 * delta1 / delta2 > 2 THEN {_Z} * sqrt((delta1 * delta1 / delta2) / (delta1 * delta1 / delta2 - 2)) ELSE 1.5 * {_Z} END AS t FROM f JOIN h ON f.user_id = h.user_id)
    SELECT t.user_id, t.x, round(fit, 5) + 0.0 AS y_smooth, round(se, 5) + 0.0 AS std_err, round(fit - t * se, 5) + 0.0 AS conf_lower, round(fit + t * se, 5) + 0.0 AS conf_upper, round(fit - t * sqrt(se * se + sd * sd), 5) + 0.0 AS pred_lower,
    round(fit + t * sqrt(se * se + sd * sd), 5) + 0.0 AS pred_upper, round(y - fit, 5) + 0.0 AS residual, round(rw, 5) + 0.0 AS rob_weight, round(leverage, 5) + 0.0 AS leverage FROM t JOIN rw2 r ON t.user_id = r.user_id AND t.x = r.x""",
)
_add(
    "surface_large_series",
    lambda spark, d: Smoother(fraction=0.2).fit_large(daily_revenue(spark, d), "x", "y").select("x", _r("y", "y", 4), _r("y_smooth", "y_smooth", 3), _r("rob_weight", "rob_weight")),
    f"{_surface_sql(_DAYS, 0.2, 3)} SELECT e2.x, round(y, 4) AS y, round(fit, 3) + 0.0 AS y_smooth, round(rw, 6) + 0.0 AS rob_weight FROM e2 JOIN rw2 ON e2.x = rw2.x",
)

# --- Structured Streaming ----------------------------------------------------------------------------


def _stream_online(spark: SparkSession, d: str) -> DataFrame:
    """The online smoother over a stream of the events, run until all input is used."""
    events = spark.readStream.schema(spark.read.parquet(f"{d}/events.parquet").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    rows = events.select("user_id", "event_id", F.col("event_id").cast("double").alias("x"), F.col("value").alias("y"))
    out = stateful.online_stream(rows, "user_id", ["x"], "y", _ONLINE, "event_id")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("user_id", "event_id", _r("y_smooth", "y_smooth", 4), _r("residual", "residual", 4))


_add(
    "stream_online",
    _stream_online,
    f"""WITH s AS (SELECT user_id, event_id, CAST(event_id AS DOUBLE) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, value AS y FROM events), t AS (SELECT *, least(k, {_CAPACITY}) AS n FROM s),
    z AS (SELECT *, greatest(2, least(n, CAST(floor(n * {_ONLINE_SPAN} + 1e-5) AS BIGINT))) AS q FROM t),
    near AS (SELECT a.user_id, a.event_id, a.x AS qx, b.x, b.y, a.x - b.x AS d, max(a.x - b.x) OVER (PARTITION BY a.user_id, a.x) AS r FROM z a JOIN z b ON a.user_id = b.user_id AND b.k <= a.k AND b.k > a.k - a.q WHERE a.n >= 3),
    w AS (SELECT *, {_kernel_sql('tricube', '(d / r)')} AS w FROM near), m AS (SELECT user_id, event_id, sum(w) AS s0, sum(w * (x - qx)) AS s1, sum(w * pow(x - qx, 2)) AS s2, sum(w * y) AS t0, sum(w * (x - qx) * y) AS t1 FROM w GROUP BY user_id, event_id),
    f AS (SELECT user_id, event_id, {_VALUE[1]} AS fit FROM m)
    SELECT s.user_id, s.event_id, round(fit, 4) + 0.0 AS y_smooth, round(y - fit, 4) + 0.0 AS residual FROM s LEFT JOIN f ON s.user_id = f.user_id AND s.event_id = f.event_id""",
)
