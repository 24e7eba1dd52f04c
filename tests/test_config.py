import pytest

from driftline import CrossValidation, SmootherBuilder, SmootherConfig
from driftline import errors as E


@pytest.mark.parametrize("adapter, fraction, iterations", [("batch", 0.67, 3), ("streaming", 0.1, 2), ("online", 0.2, 1)])
def test_defaults(adapter, fraction, iterations):
    c = SmootherConfig(adapter=adapter)
    assert (c.fraction, c.iterations, c.weight_function, c.distance_metric, c.merge_strategy, c.update_mode) == (fraction, iterations, "tricube", "normalized", "weighted_average", "incremental")


@pytest.mark.parametrize(
    "options, error",
    [
        ({"fraction": 0.0}, E.InvalidFraction), ({"fraction": 1.1}, E.InvalidFraction), ({"fraction": float("nan")}, E.InvalidFraction), ({"iterations": 1001}, E.InvalidIterations),
        ({"confidence_level": 1.0}, E.InvalidIntervals), ({"prediction_level": 0.0}, E.InvalidIntervals), ({"auto_converge": 0.0}, E.InvalidTolerance), ({"auto_converge": float("inf"), "adapter": "online"}, E.InvalidTolerance),
        ({"cell": 0.0}, E.InvalidCell), ({"cell": 0.01, "interpolation_vertices": 5}, E.InsufficientVertices), ({"adapter": "streaming", "chunk_size": 5}, E.InvalidChunkSize), ({"adapter": "streaming", "chunk_size": 10, "overlap": 10}, E.InvalidOverlap),
        ({"adapter": "online", "window_capacity": 2}, E.InvalidWindowCapacity), ({"adapter": "online", "min_points": 1}, E.InvalidMinPoints), ({"distance_metric": "minkowski", "minkowski_p": -1.0}, E.InvalidNumericValue),
        ({"distance_metric": "weighted", "metric_weights": (1.0, 2.0)}, E.MismatchedInputs), ({"weight_function": "box"}, E.InvalidInput), ({"cross_validation": CrossValidation(())}, E.InvalidFraction), ({"cross_validation": CrossValidation((0.5,), 1)}, E.InvalidNumericValue),
        ({"adapter": "online", "return_se": True, "strict": True}, E.UnsupportedFeature),
    ],
)
def test_errors(options, error):
    with pytest.raises(error):
        SmootherConfig(**options)


def test_cell_is_not_checked_in_direct_mode():
    assert SmootherConfig(cell=7.0, surface_mode="direct").cell == 7.0


def test_builder_rejects_values_set_twice_but_not_switches():
    with pytest.raises(E.DuplicateParameter):
        SmootherBuilder().set(fraction=0.5).set(fraction=0.6).build()
    assert SmootherBuilder().set(return_se=True).set(return_se=True, degree="quadratic").build().config.degree == 2


def test_last_interval_level_wins():
    c = SmootherBuilder().confidence_intervals(0.9).prediction_intervals(0.95).build().config
    assert c.confidence_level == c.prediction_level == 0.95
    assert SmootherBuilder().cross_validate([0.3], 4, 1).build().config.cross_validation.folds == 4
