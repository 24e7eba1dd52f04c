"""Plans against the NumPy kernel, batch forms against streaming forms, and the public interface."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftline import CrossValidation, Smoother, SmootherConfig, format_result, register_smooth
from driftline.operators import numeric as N
from driftline.plans import direct
from driftline.sources.tables import daily_revenue, user_activity


@pytest.fixture(scope="module")
def events(spark, sf):
    return user_activity(spark, sf).drop("n").persist()


def by_key(df, *columns):
    return {(r["user_id"], r["x"]): tuple(r[c] for c in columns) for r in df.collect()}


def test_sql_plan_equals_kernel(spark, events):
    c = SmootherConfig(fraction=0.3, iterations=1, surface_mode="direct", boundary_policy="none")
    a = by_key(Smoother(c).fit(events, "x", "y", "user_id").points, "y_smooth")
    series = direct.with_span(events.withColumn("n", F.count("*").over(direct.Window.partitionBy("user_id"))), 0.3)
    b = by_key(direct.fit_direct(series, "user_id").withColumnRenamed("qx", "x"), "fit")
    assert a.keys() == b.keys() and all(abs(a[k][0] - b[k][0]) < 1e-8 for k in a)


def test_robust_sql_plan_equals_kernel(spark, events):
    c = SmootherConfig(fraction=0.3, iterations=2, surface_mode="direct", boundary_policy="none")
    a = by_key(Smoother(c).fit(events, "x", "y", "user_id").points, "y_smooth")
    series = direct.with_span(events.withColumn("n", F.count("*").over(direct.Window.partitionBy("user_id"))), 0.3)
    b = by_key(direct.fit_robust(series, "user_id"), "fit")
    assert all(abs(a[k][0] - b[k][0]) < 1e-6 for k in a)


@pytest.mark.parametrize("options", [{}, {"fraction": 0.2, "degree": 2}, {"fraction": 0.3, "boundary_policy": "none", "iterations": 1}, {"degree": 0, "fraction": 0.3}])
def test_distributed_surface_equals_kernel(spark, sf, options):
    df = daily_revenue(spark, sf)
    c = SmootherConfig(**options)
    got = df.sparkSession.createDataFrame(Smoother(c).fit_large(df, "x", "y").collect()).toPandas().sort_values("x")
    rows = df.toPandas().sort_values("x")
    want = N.fit_series(rows["x"].to_numpy(), rows["y"].to_numpy(), c)
    assert np.allclose(got["y_smooth"], want.y, rtol=1e-6) and np.allclose(got["rob_weight"], want.weights, atol=1e-6)


def test_fit_options_and_summary(spark, events):
    s = Smoother(fraction=0.5, surface_mode="direct", confidence_level=0.95, return_diagnostics=True, return_residuals=True, cross_validation=CrossValidation((0.4, 0.6), 3, 1))
    one = events.filter("user_id = 1")
    fit = s.fit(one, "x", "y", "user_id")
    assert {"conf_lower", "conf_upper", "std_err", "residual", "leverage"} <= set(fit.points.columns) and fit.has_confidence_intervals and not fit.has_prediction_intervals and fit.has_cv_scores
    summary = fit.summary.collect()
    assert len(summary) == 1 and summary[0]["fraction_used"] in (0.4, 0.6) and summary[0]["diagnostics"]["rmse"] > 0
    assert fit.best_cv_score().first()["best_cv_score"] == min(summary[0]["cv_scores"])
    text = format_result(fit, "x", "y")
    assert "Data points" in text and "..." in text


def test_input_order_does_not_matter(spark, events):
    s = Smoother(fraction=0.4)
    assert by_key(s.fit(events.orderBy(F.rand(3)), "x", "y", "user_id").points, "y_smooth") == by_key(s.fit(events, "x", "y", "user_id").points, "y_smooth")


def test_bad_rows(spark):
    df = spark.createDataFrame([(1, float(i), float(i)) for i in range(9)] + [(1, None, 1.0), (1, 3.5, float("nan"))], "k int, x double, y double")
    with pytest.raises(Exception, match="must be finite"):
        Smoother(fraction=0.9).fit(df, "x", "y", "k").points.count()
    assert Smoother(fraction=0.9).fit(df, "x", "y", "k", na="drop").points.count() == 9


def test_predict(spark):
    train = spark.createDataFrame([(1, float(i), 2.0 * i + 1) for i in range(20)], "k int, x double, y double")
    ask = spark.createDataFrame([(1, 2.5), (1, 30.0), (2, 1.0)], "k int, x double")
    got = {(r["k"], r["x"]): r["y_smooth"] for r in Smoother(fraction=0.5).predict(train, ask, "x", "y", "k").collect()}
    assert got[1, 2.5] == pytest.approx(6) and got[1, 30.0] == pytest.approx(61) and got[2, 1.0] is None


def test_cross_validation_fans_out(spark, events):
    s = Smoother(iterations=1, cross_validation=CrossValidation((0.3, 0.7), 4))
    rows = s.cross_validate(events, "x", "y", "user_id").collect()
    assert len(rows) == 2 * len({r["user_id"] for r in rows}) and sum(r["best"] for r in rows) == len(rows) / 2


@pytest.mark.parametrize("n", [15, 40, 100, 23, 10, 3])
def test_chunks_give_every_row_once_and_a_line_back(spark, n):
    df = spark.createDataFrame([(1, float(i), 2.0 * i + 1) for i in range(n)], "user_id int, x double, y double")
    c = SmootherConfig(adapter="streaming", chunk_size=10, overlap=2, fraction=0.5, boundary_policy="none", surface_mode="direct")  # padding and blending would bend a line
    rows = Smoother(c).smooth_chunks(df, "x", "y", "user_id").collect()
    assert sorted(r["x"] for r in rows) == list(range(n)) and all(abs(r["y_smooth"] - r["y"]) < 1e-8 for r in rows)


def stream_of(spark, tmp_path, df, partitions):
    path = str(tmp_path / "in")
    for part in partitions:
        df.filter(part).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_stream(out, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return out.sparkSession.table(name)


@pytest.mark.parametrize("strategy", ["weighted_average", "take_last"])
def test_chunk_stream_equals_batch(spark, events, tmp_path, strategy):
    c = SmootherConfig(adapter="streaming", chunk_size=20, overlap=5, fraction=0.4, merge_strategy=strategy)
    few = events.filter("user_id < 4").withColumn("over", F.lit(False))
    ends = few.select("user_id").distinct().select("user_id", F.lit(1e9).alias("x"), F.lit(0.0).alias("y"), F.lit(True).alias("over"))
    df = few.unionByName(ends)
    stream = stream_of(spark, tmp_path, df, ["x <= 13", "x > 13 and x <= 47", "x > 47"])
    got = by_key(run_stream(Smoother(c).stream_chunks(stream, "user_id", "x", "y", "x", end="over"), tmp_path, f"chunks_{strategy}"), "y_smooth", "rob_weight")
    want = by_key(Smoother(c).smooth_chunks(few.drop("over"), "x", "y", "user_id"), "y_smooth", "rob_weight")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_online_stream_equals_batch(spark, events, tmp_path):
    c = SmootherConfig(adapter="online", window_capacity=12, fraction=0.6, update_mode="full", iterations=2)
    few = events.filter("user_id < 3")
    stream = stream_of(spark, tmp_path, few, ["x <= 9", "x > 9"])
    got = by_key(run_stream(Smoother(c).stream_online(stream, "user_id", "x", "y", "x"), tmp_path, "online"), "y_smooth", "rob_weight")
    want = by_key(Smoother(c).smooth_online(few, "x", "y", "user_id"), "y_smooth", "rob_weight")
    none = lambda t: [np.nan if v is None else v for v in t]
    assert got.keys() == want.keys() and all(np.allclose(none(got[k]), none(want[k]), equal_nan=True) for k in want)


@pytest.mark.parametrize("options", [{"surface_mode": "direct", "boundary_policy": "none"}, {"update_mode": "full", "iterations": 2}])
def test_a_reset_empties_the_window(spark, events, tmp_path, options):
    c = SmootherConfig(adapter="online", window_capacity=8, fraction=0.7, **options)
    few = events.filter("user_id < 3").withColumn("anew", F.col("x").isin(5.0, 20.0))
    got = by_key(run_stream(Smoother(c).stream_online(stream_of(spark, tmp_path, few, ["x <= 9", "x > 9"]), "user_id", "x", "y", "x", "anew"), tmp_path, "reset"), "y_smooth", "window_rows")
    parts = few.withColumn("part", (F.col("x") >= 5).cast("int") + (F.col("x") >= 20).cast("int"))
    want = by_key(Smoother(c).smooth_online(parts, "x", "y", ["user_id", "part"]), "y_smooth", "window_rows")
    none = lambda t: [np.nan if v is None else v for v in t]
    assert got.keys() == want.keys() and all(np.allclose(none(got[k]), none(want[k]), equal_nan=True) for k in want)


def test_a_reset_begins_chunks_anew(spark, events, tmp_path):
    c = SmootherConfig(adapter="streaming", chunk_size=10, overlap=3, fraction=0.5)
    few = events.filter("user_id < 3").withColumn("anew", F.col("x") == 18)
    ends = few.select("user_id").distinct().select("user_id", F.lit(1e9).alias("x"), F.lit(0.0).alias("y"), F.lit(False).alias("anew"), F.lit(True).alias("over"))
    df = few.withColumn("over", F.lit(False)).unionByName(ends)
    got = by_key(run_stream(Smoother(c).stream_chunks(stream_of(spark, tmp_path, df, ["x <= 13", "x > 13"]), "user_id", "x", "y", "x", "over", None, "anew"), tmp_path, "anew"), "y_smooth")
    want = by_key(Smoother(c).smooth_chunks(few.withColumn("part", F.col("x") >= 18), "x", "y", ["user_id", "part"]), "y_smooth")
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


def test_long_series_are_split_without_a_seam(spark, monkeypatch):
    from driftline.operators import chunks, online

    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(k, float(i) + rng.random() / 2, float(rng.normal())) for k in range(2) for i in range(200 + k)], "user_id int, x double, y double")
    streaming = Smoother(adapter="streaming", chunk_size=10, overlap=4, fraction=0.5)
    live = Smoother(adapter="online", window_capacity=9, fraction=0.6, surface_mode="direct", boundary_policy="none")
    a, b = by_key(streaming.smooth_chunks(df, "x", "y", "user_id"), "chunk", "y_smooth", "rob_weight"), by_key(live.smooth_online(df, "x", "y", "user_id"), "y_smooth", "window_rows")
    monkeypatch.setattr(chunks, "TOGETHER", 2)
    monkeypatch.setattr(online, "SEGMENT", 16)
    assert by_key(streaming.smooth_chunks(df, "x", "y", "user_id"), "chunk", "y_smooth", "rob_weight") == a
    again = by_key(live.smooth_online(df, "x", "y", "user_id"), "y_smooth", "window_rows")
    assert again.keys() == b.keys() and all(again[k][1] == b[k][1] and (b[k][0] is None) == (again[k][0] is None) and np.isclose(again[k][0] or 0, b[k][0] or 0) for k in b)


def test_series_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(k, float(i), float((i * k) % 5)) for k in range(5) for i in range(3 + 9 * k)], "user_id int, x double, y double")
        got = by_key(Smoother(fraction=0.8).fit(df, "x", "y", "user_id").points, "y_smooth")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(5):
        x = np.arange(3 + 9 * k, dtype=float)
        want = N.fit_series(x[:, None], (x * k) % 5, SmootherConfig(fraction=0.8)).y
        assert np.allclose([got[k, i][0] for i in x], want)


def test_incremental_equals_full_without_reweighting(spark, events):
    one = events.filter("user_id = 2")
    a, b = (by_key(Smoother(adapter="online", window_capacity=10, fraction=0.5, iterations=0, update_mode=m).smooth_online(one, "x", "y", "user_id"), "y_smooth") for m in ("incremental", "full"))
    assert a == b


def test_sql_table_function(spark, events):
    events.filter("user_id = 1").createOrReplaceTempView("one_series")
    register_smooth(spark, "smooth_series", fraction=0.5)
    rows = spark.sql("SELECT * FROM smooth_series(TABLE (SELECT user_id, x, y FROM one_series) PARTITION BY user_id ORDER BY x)").collect()
    want = by_key(Smoother(fraction=0.5).fit(events.filter("user_id = 1"), "x", "y", "user_id").points, "y_smooth")
    assert {(int(r["key"]), r["x"]): (r["y_smooth"],) for r in rows} == want


def test_hooks_and_single_precision(spark, events):
    one = events.filter("user_id = 1")
    a = by_key(Smoother(fraction=0.5, custom_weight=lambda u: N.kernel("tricube", u)).fit(one, "x", "y", "user_id").points, "y_smooth")
    assert a == by_key(Smoother(fraction=0.5).fit(one, "x", "y", "user_id").points, "y_smooth")
    mean = lambda x, y, c: N.Fit(np.full(len(y), y.mean()), np.ones(len(y)), 1, c.fraction)
    rows = Smoother().fit(one, "x", "y", "user_id", custom_fit=mean, precision="float").points
    assert rows.schema["y_smooth"].dataType.simpleString() == "float" and rows.select("y_smooth").distinct().count() == 1


def test_best_fraction_fits_each_series_once(spark, sf):
    from driftline import catalog

    assert catalog.QUERIES["best_fraction"](spark, sf)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
