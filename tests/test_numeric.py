import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftline import CrossValidation, SmootherConfig
from driftline import errors as E
from driftline.functions.columns import efficiency
from driftline.operators import numeric as N


def config(**options):
    return SmootherConfig(**({"fraction": 0.5} | options))


@pytest.mark.parametrize("n, f, q", [(100, 0.01, 2), (100, 1.0, 100), (1, 0.5, 2), (2, 0.5, 2), (3, 0.5, 2), (100, 0.67, 67)])
def test_span(n, f, q):
    assert N.span(n, f) == q


@pytest.mark.parametrize("name, u, w", [("tricube", 0, 1), ("epanechnikov", 0.5, 0.75), ("triangle", 0.2, 0.8), ("cosine", 0.5, math.cos(math.pi / 4)), ("tricube", 1, 0), ("uniform", -1, 0), ("biweight", 0.5, 0.5625)])
def test_kernels(name, u, w):
    assert N.kernel(name, np.array([float(u)]))[0] == pytest.approx(w)


def test_gaussian_never_vanishes():
    assert N.kernel("gaussian", np.array([1000.0]))[0] > 0


def test_window_weights():
    w, right = N.window_weights(np.array([1.0, 2, 3]), 0, 2, 5, 1, 0.001, 0.999, "tricube")
    assert w.sum() == 0 and right == 0
    w, right = N.window_weights(np.array([0.0, 1, 10]), 0, 2, 0, 2, 0, 2, "tricube")
    assert w[0] == 1 and w[1] > 0 and w[2] == 0 and right == 1


@pytest.mark.parametrize(
    "metric, a, b, more, want",
    [
        ("euclidean", (0, 0), (3, 4), {}, 5), ("manhattan", (1, 2), (4, 6), {}, 7), ("chebyshev", (1, 2), (4, 7), {}, 5),
        ("minkowski", (1, 2), (4, 6), {"minkowski_p": 3.0}, 91 ** (1 / 3)), ("minkowski", (1, 2), (4, 6), {"minkowski_p": 1.0}, 7), ("minkowski", (0, 0), (3, 4), {"minkowski_p": 2.0}, 5),
        ("weighted", (1, 2), (2, 3), {"metric_weights": (4.0, 1.0)}, math.sqrt(5)),
    ],
)
def test_distances(metric, a, b, more, want):
    c = config(dimensions=2, distance_metric=metric, **more)
    assert N.distances(np.array([a], float), np.array([b], float), c, np.ones(2))[0, 0] == pytest.approx(want)


def test_normalized_distance():
    d = N.distances(np.array([[0.0, 10]]), np.array([[10.0, 20]]), config(dimensions=2), np.array([0.1, 0.05]))
    assert d[0, 0] == pytest.approx(math.sqrt(1.25))


def test_neighbours_of_a_plane():
    points = np.array([[0.0, 0], [5, 0], [2, 0], [7, 0]])
    index, gap = N.Neighbours(points, config(dimensions=2, distance_metric="euclidean"), np.ones(2)).find(np.array([[0.0, 0]]), 2)
    assert sorted(index[0]) == [0, 2] and gap.max() == 2


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=2, max_size=30), st.integers(1, 8))
def test_neighbours_on_a_line_are_the_nearest(xs, q):
    x = np.sort(np.array(xs, float))[:, None]
    q = min(q, len(x))
    _, gap = N.Neighbours(x, config(distance_metric="euclidean"), np.ones(1)).find(x, q)
    assert np.allclose(np.sort(gap, axis=1), np.sort(np.abs(x - x.T), axis=1)[:, :q])


def test_monomials_of_a_plane():
    at = np.array([2.0, 3.0])
    assert N.basis(at, 2).tolist() == [1, 2, 3, 4, 6, 9]
    assert N.basis(at, 3).tolist()[6:] == [8, 12, 18, 27]
    assert N.basis(np.array([2.0, 1.0]), 4).tolist()[10:] == [16, 8, 4, 2, 1]
    assert [len(N.monomials(d, k)) for d, k in ((1, 4), (2, 4), (3, 2))] == [5, 15, 10]


@pytest.mark.parametrize(
    "policy, x, y, q, px, py",
    [
        ("extend", [0, 1], [10, 20], 2, [-1, 0, 1, 2], [10, 10, 20, 20]), ("zero", [0, 1], [10, 20], 2, [-1, 0, 1, 2], [0, 10, 20, 0]),
        ("reflect", [0, 1, 2, 3, 4], [1, 2, 3, 4, 5], 3, [-1, 0, 1, 2, 3, 4, 5], [2, 1, 2, 3, 4, 5, 4]), ("extend", [0, 1, 3, 6, 10], [0] * 5, 3, [-1, 0, 1, 3, 6, 10, 14], [0] * 7),
        ("none", [0, 1], [1, 2], 2, [0, 1], [1, 2]), ("extend", [5], [1], 4, [5], [1]), ("extend", [0, 1, 2], [1, 1, 1], 1, [0, 1, 2], [1, 1, 1]),
    ],
)
def test_padding(policy, x, y, q, px, py):
    got = N.pad(np.array(x, float)[:, None], np.array(y, float), policy, q)
    assert got[0][:, 0].tolist() == px and got[1].tolist() == py


def test_padding_takes_weights_of_the_end_rows():
    for policy in ("extend", "reflect", "zero"):
        source = N.pad(np.arange(5.0)[:, None], np.arange(5.0), policy, 4)[2]
        assert source.tolist() == [0, 0, 0, 1, 2, 3, 4, 4, 4]


def test_padding_of_planes_mirrors():
    x = np.array([[0.0, 0.2], [1, 0.1], [0.3, 1], [0.8, 0.9], [0.5, 0.5]])
    px, py, source = N.pad(x, np.arange(5.0), "reflect", 4)
    assert len(px) > 5 and (py == np.arange(5.0)[source]).all()
    assert px.min() < 0 and px.max() > 1


@pytest.mark.parametrize("values, want", [([1, 2, 3, 4], 1), ([1, 1, 2, 2, 4], 1), ([-10, 0, 10], 10), ([1, 10], 4.5), ([1, 2, 3, 100], 1)])
def test_mad(values, want):
    assert N.mad(np.array(values, float)) == want


def test_robustness_by_scale():
    r = np.arange(10.0, 15)
    assert (N.robustness_weights(r, "bisquare", "mar") > 0).all()
    assert N.robustness_weights(r, "bisquare", "mad")[0] == 0
    assert (N.robustness_weights(np.zeros(4), "huber", "mad") == 1).all()


@pytest.mark.parametrize("degree", range(5))
def test_polynomials_are_reproduced(degree):
    x = np.linspace(-1, 1, 40)
    y = sum((k + 1) * x**k for k in range(degree + 1))
    fit = N.fit_series(x, y, config(degree=degree, surface_mode="direct", boundary_policy="none", iterations=1, fraction=0.6))
    assert np.allclose(fit.y, y, atol=1e-8)


@pytest.mark.parametrize("d", [2, 3])
@pytest.mark.parametrize("mode", ["direct", "interpolation"])
def test_planes_are_reproduced(d, mode):
    x = np.random.default_rng(d).random((150, d))
    y = x @ np.arange(1.0, d + 1) - 2
    assert np.allclose(N.fit_series(x, y, config(dimensions=d, surface_mode=mode)).y, y, atol=1e-8)


def test_tiny_line_is_interpolated():
    fit = N.fit_series(np.arange(1.0, 6), np.array([2, 4.1, 5.9, 8.2, 9.8]), config())
    assert fit.y.tolist() == [2, 4.1, 5.9, 8.2, 9.8] and (fit.weights == 1).all() and fit.iterations_used == 2


def test_outliers_lose_weight():
    y = 2 * np.arange(10.0)
    y[2], y[7] = 100, -100
    fit = N.fit_series(np.arange(10.0), y, config(iterations=3))
    assert fit.weights[2] < 0.8 and fit.weights[7] < 0.8


def test_equal_x_and_equal_y():
    assert np.isfinite(N.fit_series(np.full(10, 5.0), np.arange(10.0), config()).y).all()
    assert np.allclose(N.fit_series(np.arange(5.0), np.full(5, 10.0), config(surface_mode="direct")).y, 10)
    assert N.fit_series(np.ones(3), np.array([10.0, 20, 30]), config(surface_mode="direct", fraction=1.0, boundary_policy="none", iterations=1)).y[1] == pytest.approx(20)


@pytest.mark.parametrize("fallback, want", [("use_local_mean", 20.0), ("return_original", 30.0), ("return_none", 30.0)])
def test_vanished_weights(fallback, want):
    x, y = np.arange(3.0)[:, None], np.array([10.0, 20, 30])
    c = config(zero_weight_fallback=fallback)
    fits = N.LocalFits(x, y, x, *N.Neighbours(x, c, np.ones(1)).find(x, 3), c)
    assert fits.values(np.zeros(3), y, fallback)[0][2] == want


def test_surface_box_and_cuts():
    x = np.arange(5.0)[:, None]
    c = config(fraction=1.0, cell=1.0)
    s = N.Surface(x, x[:, 0], c, 5, N.Neighbours(x, c, np.ones(1)), np.ones(5))
    assert s.cells[0][0][0] == pytest.approx(-0.02) and s.cells[0][1][0] == pytest.approx(4.02) and len(s.cells) == 1


def test_surface_is_equivariant_in_y():
    rng = np.random.default_rng(3)
    x, y = np.sort(rng.random(80)), rng.random(80)
    a = N.fit_series(x, y, config(iterations=1)).y
    assert np.allclose(N.fit_series(x, 3 * y - 7, config(iterations=1)).y, 3 * a - 7)


def test_vertex_limit_keeps_cells_down():
    x = np.arange(100.0)[:, None]
    c = config(interpolation_vertices=3)
    s = N.Surface(x, x[:, 0], c, 50, N.Neighbours(x, c, np.ones(1)), np.ones(100))
    assert len(s.corners) <= 3


def test_between():
    x, y = np.array([1.0, 3, 4]), np.array([2.0, 6, 8])
    assert N.between(x, y, np.array([3.5, 0, 10, 1])).tolist() == [7, 2, 8, 2]
    assert N.between(x[:0], y[:0], np.array([1.0])).tolist() == [0]
    assert N.between(x[:1], y[:1], np.array([9.0])).tolist() == [2]


def test_folds():
    assert [f.tolist() for f in N.fold_rows(7, CrossValidation((0.5,), 3))] == [[0, 1], [2, 3], [4, 5, 6]]
    assert sorted(N.shuffled(20, 5).tolist()) == list(range(20)) and N.shuffled(20, 5).tolist() != list(range(20))
    assert N.cross_validate(np.arange(3.0)[:, None], np.arange(3.0), config(cross_validation=CrossValidation((0.4, 0.6), 5))) == (0.4, [0.0, 0.0])


def test_cross_validation_prefers_the_better_span():
    x = np.linspace(0, 1, 60)
    fit = N.fit_series(x, np.sin(20 * x), config(cross_validation=CrossValidation((0.9, 0.15), 5, 1)))
    assert fit.fraction == 0.15 and len(fit.cv_scores) == 2 and fit.cv_scores[1] < fit.cv_scores[0]
    assert N.fit_series(x[:12], x[:12], config(cross_validation=CrossValidation((0.5,), None))).cv_scores[0] < 0.1


def test_diagnostics():
    d = N.diagnose(np.array([0.0, 2, 4]), np.array([0.0, 1, 3]), None)
    assert d["rmse"] == pytest.approx(math.sqrt(2 / 3)) and d["mae"] == pytest.approx(2 / 3)
    assert N.diagnose(np.array([1.0, 2, 3]), np.array([1.0, 2, 2]), None)["r_squared"] == 0.5
    assert N.diagnose(np.ones(3), np.zeros(3), None)["r_squared"] == 0 and N.diagnose(np.ones(1), np.zeros(1), None)["r_squared"] == 1
    assert N.residual_sd(np.array([-2.0])) == pytest.approx(2 * 1.4826) and N.residual_sd(np.ones(4)) == pytest.approx(1.4826e-12)
    assert N.akaike(2.0, 2, 1) == (2.0, math.inf) and N.akaike(0.0, 5, 1) == (math.inf, math.inf)
    assert math.isfinite(N.akaike(1.0, 5, 3)[1]) and N.akaike(1.0, 5, 4)[1] == math.inf


def test_critical_values():
    assert [N.critical_z(v) for v in (0.95, 0.99, 0.90)] == [1.96, 2.576, 1.645] and 3 < N.critical_z(0.999) < 3.4
    assert N.normal_quantile(0.8) == pytest.approx(0.8416212, abs=1e-6)
    assert N.critical_t(0.95, 2) == pytest.approx(1.5 * 1.96)


def test_window_se():
    se = N.window_se(np.arange(3.0), np.array([0.0, 1, 0]), np.zeros(3), "uniform", 3)
    assert se[1] == pytest.approx(0) or se[1] == pytest.approx(math.sqrt(1 / 3))
    assert (N.window_se(np.ones(3), np.ones(3), np.zeros(3), "tricube", 3) == 0).all()


def test_intervals_contain_the_fit():
    rng = np.random.default_rng(0)
    x = np.linspace(0, 1, 50)
    y = x + rng.normal(0, 0.1, 50)
    for mode in ("direct", "interpolation"):
        fit = N.fit_series(x, y, config(surface_mode=mode, confidence_level=0.95, prediction_level=0.95))
        assert (fit.lower["pred"] <= fit.lower["conf"]).all() and (fit.lower["conf"] <= fit.y).all() and (fit.y <= fit.upper["conf"]).all()
        assert (fit.hat is None) == (mode == "interpolation")
        assert mode == "direct" or np.ptp(fit.std_err) == 0
    assert efficiency("epanechnikov") == pytest.approx(1)


def test_perfect_fit_has_minimal_intervals():
    fit = N.fit_series(np.arange(20.0), np.full(20, 3.0), config(confidence_level=0.9))
    assert np.allclose(fit.upper["conf"] - fit.lower["conf"], 1e-12, atol=1e-12)


@pytest.mark.parametrize("x, y, error", [([], [], E.EmptyInput), ([1.0], [1.0], E.TooFewPoints), ([1.0, 2], [1.0], E.MismatchedInputs), ([1.0, np.nan], [1.0, 2], E.InvalidNumericValue), ([1.0, 2], [1.0, np.inf], E.InvalidNumericValue)])
def test_bad_data(x, y, error):
    with pytest.raises(error):
        N.fit_series(np.array(x), np.array(y), config())


def test_online_two_points():
    c = config(adapter="online", min_points=2)
    assert N.online_value(np.array([[0.0], [1]]), np.array([1.0, 3]), c)[0] == 3
    assert N.online_value(np.array([[1.0], [1]]), np.array([1.0, 3]), c) == (2.0, 1.0, 0)


@pytest.mark.parametrize("strategy, want", [("average", [1, 1]), ("weighted_average", [0, 1]), ("take_first", [0, 0]), ("take_last", [2, 2])])
def test_merging(strategy, want):
    assert N.merged(np.zeros(2), np.full(2, 2.0), strategy).tolist() == want


@pytest.mark.parametrize("d", [1, 2])
@pytest.mark.parametrize("metric", ["normalized", "euclidean", "manhattan"])
def test_windows_at_once_equal_one_by_one(d, metric):
    rng = np.random.default_rng(d)
    x, y = rng.random((40, d)), rng.random(40)
    c = SmootherConfig(adapter="online", dimensions=d, distance_metric=metric, fraction=0.7, window_capacity=12, surface_mode="direct", boundary_policy="none")
    want = [N.smooth(x[k - 12 : k], y[k - 12 : k], c, iterations=0).y[-1] for k in range(12, 41)]
    assert np.allclose(N.full_windows(x, y, c), want)
    assert N.online_value(x[:7], y[:7], c)[0] == pytest.approx(N.smooth(x[:7], y[:7], c, iterations=0).y[-1])


@pytest.mark.parametrize("d", [1, 2])
def test_a_query_leaves_its_own_point_out(d):
    rng = np.random.default_rng(d)
    x = np.round(rng.random((60, d)) * 5) if d == 2 else np.sort(rng.integers(0, 40, (60, 1)), axis=0).astype(float)
    near = N.Neighbours(x, SmootherConfig(dimensions=d, distance_metric="euclidean"), N.scales_of(x))
    index, gap = near.find(x, 7, skip=np.arange(60))
    assert index.shape == (60, 7) and (index != np.arange(60)[:, None]).all()
    for k in range(60):
        own = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        assert np.allclose(np.sort(gap[k]), np.sort(np.delete(own, k))[:7])


@pytest.mark.parametrize("d", [1, 2])
def test_fits_by_blocks_equal_fits_at_once(d, monkeypatch):
    rng = np.random.default_rng(5)
    x, y = (np.sort(rng.random((300, d)), axis=0), rng.normal(size=300))
    c = SmootherConfig(dimensions=d, fraction=0.4, surface_mode="direct", iterations=3, confidence_level=0.9)
    whole = N.fit_series(x, y, c)
    monkeypatch.setattr(N, "KEPT", 1000)
    monkeypatch.setattr(N, "BLOCK", 5000)
    parts = N.fit_series(x, y, c)
    assert np.allclose(whole.y, parts.y) and np.allclose(whole.leverage, parts.leverage) and np.allclose(whole.weights, parts.weights)


@pytest.mark.parametrize("seed", [None, 3])
@pytest.mark.parametrize("policy, iterations", [("none", 1), ("extend", 1), ("none", 3)])
def test_folds_fit_only_the_rows_that_the_held_out_ones_lie_between(seed, policy, iterations, monkeypatch):
    rng = np.random.default_rng(8)
    x, y = np.round(np.sort(rng.random((90, 1)), axis=0), 2), rng.normal(size=90)
    c = SmootherConfig(fraction=0.4, surface_mode="direct", boundary_policy=policy, iterations=iterations)
    folds = N.fold_rows(90, CrossValidation((0.4,), 5, seed))
    want = [(y[t] - np.interp(x[t, 0], np.delete(x[:, 0], t), N.smooth(np.delete(x, t, 0), np.delete(y, t), c).y)) ** 2 for t in folds]
    asked, fits = [], N.local_fits
    monkeypatch.setattr(N, "local_fits", lambda *a: asked.append(len(a[2])) or fits(*a))
    got = [N._held_out_error(x, y, t, c) for t in folds]
    assert np.allclose(np.concatenate(got), np.concatenate(want))
    assert iterations > 1 or max(asked) <= (2 * 18 if seed else 6)


@pytest.mark.parametrize("name", sorted(N.POLYNOMIALS))
@pytest.mark.parametrize("degree", [0, 1, 2])
@pytest.mark.parametrize("kind", ["grid", "uneven", "ties", "clusters", "far"])
def test_fits_by_moments_equal_fits_by_points(name, degree, kind):
    rng = np.random.default_rng(degree)
    n = 700
    x = {"grid": np.arange(n), "uneven": np.exp(4 * rng.normal(size=n)), "ties": rng.integers(0, 9, n), "clusters": np.r_[rng.random(n // 2) * 1e-6, rng.random(n // 2) * 1e3], "far": 1e9 + rng.random(n)}[kind].astype(float)[:, None]
    y, robust = 900 + rng.normal(size=n).cumsum(), rng.random(n) * (rng.random(n) > 0.3)
    c = SmootherConfig(fraction=0.35, degree=degree, weight_function=name, surface_mode="direct")
    near, queries = N.Neighbours(x, c, N.scales_of(x)), np.r_[x, x[:50] + np.ptp(x) / 9, x[:1] - 5 * np.ptp(x)]
    args = robust, np.zeros(len(queries)), "use_local_mean"
    for got, want in zip(N.MomentFits(x, y, queries, near, 245, c).values(*args), N.BlockwiseFits(x, y, queries, near, 245, c).values(*args), strict=True):
        assert np.allclose(got, want, rtol=1e-8, atol=1e-10 * np.abs(want).max())


def test_a_long_direct_fit_visits_no_neighbourhood_point_by_point(monkeypatch):
    monkeypatch.setattr(N.LocalFits, "__post_init__", lambda self: pytest.fail("point by point"))
    x = np.arange(20000.0)
    fit = N.fit_series(x, 3 * x - 7, SmootherConfig(fraction=0.8, iterations=1, surface_mode="direct", boundary_policy="none"))
    assert np.allclose(fit.y, 3 * x - 7)


@pytest.mark.parametrize("degree, name, metric", [(1, "tricube", "normalized"), (2, "biweight", "euclidean"), (1, "cosine", "normalized"), (0, "triangle", "manhattan"), (3, "tricube", "euclidean")])
@pytest.mark.parametrize("kind", ["grid", "uneven", "ties", "unsorted", "equal", "four"])
def test_leaving_one_out_equals_one_fit_for_each_row(degree, name, metric, kind, monkeypatch):
    rng = np.random.default_rng(degree)
    n = 4 if kind == "four" else 180
    x = {"grid": np.arange(n), "uneven": np.sort(np.exp(4 * rng.normal(size=n))), "ties": np.sort(rng.integers(0, 60, n)), "unsorted": rng.random(n), "equal": np.ones(n), "four": np.arange(n)}[kind].astype(float)[:, None]
    y = 900 + rng.normal(size=n).cumsum()
    for fraction in (0.05, 0.6):
        c = SmootherConfig(fraction=fraction, degree=degree, weight_function=name, distance_metric=metric, iterations=1, surface_mode="direct", boundary_policy="none", cross_validation=CrossValidation((fraction,), None))
        want = []
        for k in range(n):
            rest = np.delete(np.arange(n), k)
            rest = rest[np.argsort(x[rest, 0], kind="stable")]
            want.append((y[k] - N.between(x[rest, 0], N.smooth(x[rest], y[rest], c.but(cross_validation=None)).y, x[k, 0])[()]) ** 2)
        for kept in (8_000_000, 0):  # at once, then by moments or blocks
            monkeypatch.setattr(N, "KEPT", kept)
            assert N.cross_validate(x, y, c)[1][0] == pytest.approx(math.sqrt(np.mean(want)), rel=1e-9)
        monkeypatch.undo()


def test_leaving_one_out_of_a_long_series_takes_no_fit_for_each_row(monkeypatch):
    asked, fits = [], N.local_fits
    monkeypatch.setattr(N, "local_fits", lambda *a: asked.append(len(a[2])) or fits(*a))
    x = np.arange(5000.0)
    c = SmootherConfig(iterations=1, surface_mode="direct", boundary_policy="none", cross_validation=CrossValidation((0.5, 1.0), None))
    assert max(N.cross_validate(x[:, None], 2 * x, c)[1]) < 0.05
    assert len(asked) <= 6
