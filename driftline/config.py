"""Configuration of a smoother: options, defaults per adapter and their validation."""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Callable
from dataclasses import dataclass

from driftline import errors as E

KERNELS = ("cosine", "epanechnikov", "gaussian", "biweight", "triangle", "tricube", "uniform")
METRICS = ("euclidean", "normalized", "manhattan", "chebyshev", "minkowski", "weighted")
DEGREES = {"constant": 0, "linear": 1, "quadratic": 2, "cubic": 3, "quartic": 4}
FALLBACKS = ("use_local_mean", "return_original", "return_none")
ROBUSTNESS = ("bisquare", "huber", "talwar")
SCALES = ("mar", "mad")
BOUNDARIES = ("extend", "reflect", "zero", "none")
SURFACES = ("interpolation", "direct")
MERGES = ("average", "weighted_average", "take_first", "take_last")
UPDATES = ("full", "incremental")
#: Span and number of iterations that each adapter starts from.
DEFAULTS = {"batch": (0.67, 3), "streaming": (0.1, 2), "online": (0.2, 1)}


@dataclass(frozen=True)
class CrossValidation:
    """Candidate spans and the way to compare them; ``folds`` None: leave one out. No seed: folds in order."""

    fractions: tuple[float, ...]
    folds: int | None = 5
    seed: int | None = None


@dataclass(frozen=True)
class SmootherConfig:
    """All options of a fit. None for ``fraction`` and ``iterations`` takes the adapter's default."""

    adapter: str = "batch"
    fraction: float | None = None
    iterations: int | None = None
    weight_function: str = "tricube"
    robustness_method: str = "bisquare"
    scaling_method: str = "mad"
    degree: int | str = 1
    dimensions: int = 1
    distance_metric: str = "normalized"
    minkowski_p: float = 2.0
    metric_weights: tuple[float, ...] | None = None
    boundary_policy: str = "extend"
    zero_weight_fallback: str = "use_local_mean"
    surface_mode: str = "interpolation"
    cell: float | None = None
    interpolation_vertices: int | None = None
    boundary_degree_fallback: bool = True
    auto_converge: float | None = None
    return_se: bool = False
    confidence_level: float | None = None
    prediction_level: float | None = None
    cross_validation: CrossValidation | None = None
    return_diagnostics: bool = False
    return_residuals: bool = False
    return_robustness_weights: bool = False
    chunk_size: int = 5000
    overlap: int = 500
    merge_strategy: str = "weighted_average"
    window_capacity: int = 1000
    min_points: int = 3
    update_mode: str = "incremental"
    compat: bool = True
    strict: bool = False
    #: A vectorised weight function of the scaled distance, in place of ``weight_function``.
    custom_weight: Callable | None = None

    def __post_init__(self) -> None:
        if self.adapter not in DEFAULTS:
            raise E.InvalidInput(f"adapter {self.adapter!r} is not one of {', '.join(DEFAULTS)}")
        span, passes = DEFAULTS[self.adapter]
        put = lambda k, v: object.__setattr__(self, k, v)
        put("fraction", span if self.fraction is None else self.fraction)
        put("iterations", passes if self.iterations is None else self.iterations)
        put("degree", DEGREES.get(self.degree, self.degree) if isinstance(self.degree, str) else self.degree)
        if self.confidence_level is not None and self.prediction_level is not None and self.confidence_level != self.prediction_level:
            raise E.InvalidIntervals("confidence and prediction intervals share one level")
        validate(self)

    @property
    def level(self) -> float | None:
        """The level of the intervals asked for."""
        return self.prediction_level if self.confidence_level is None else self.confidence_level

    @property
    def wants_errors(self) -> bool:
        return self.return_se or self.level is not None

    @property
    def coefficients(self) -> int:
        """Terms of the local polynomial."""
        return math.comb(self.degree + self.dimensions, self.degree)

    def but(self, **changes) -> SmootherConfig:
        """A copy with some options changed."""
        return dataclasses.replace(self, **changes)


def check_fraction(value: float) -> None:
    if not (math.isfinite(value) and 0 < value <= 1):
        raise E.InvalidFraction(f"a span fraction must be in (0, 1], not {value}")


def required_vertices(fraction: float, cell: float, dimensions: int) -> int:
    """Vertices that a regular grid of cells of this size would have."""
    return (math.ceil(1 / (fraction * cell)) + 1) ** dimensions


def validate(c: SmootherConfig) -> None:
    """Raise the first error of the configuration, in a fixed order of checks."""
    check_fraction(c.fraction)
    if not 0 <= c.iterations <= 1000:
        raise E.InvalidIterations(f"iterations must be between 0 and 1000, not {c.iterations}")
    for name, value, known in (
        ("weight_function", c.weight_function, KERNELS),
        ("distance_metric", c.distance_metric, METRICS),
        ("robustness_method", c.robustness_method, ROBUSTNESS),
        ("scaling_method", c.scaling_method, SCALES),
        ("boundary_policy", c.boundary_policy, BOUNDARIES),
        ("zero_weight_fallback", c.zero_weight_fallback, FALLBACKS),
        ("surface_mode", c.surface_mode, SURFACES),
        ("merge_strategy", c.merge_strategy, MERGES),
        ("update_mode", c.update_mode, UPDATES),
        ("degree", c.degree, tuple(DEGREES.values())),
    ):
        if value not in known:
            raise E.InvalidInput(f"{name} {value!r} is not one of {', '.join(map(str, known))}")
    if c.dimensions < 1:
        raise E.InvalidInput("dimensions must be at least 1")
    if c.distance_metric == "minkowski" and not (math.isfinite(c.minkowski_p) and c.minkowski_p > 0):
        raise E.InvalidNumericValue("the Minkowski exponent must be positive and finite")
    if c.distance_metric == "weighted" and (c.metric_weights is None or len(c.metric_weights) != c.dimensions or not all(math.isfinite(w) and w >= 0 for w in c.metric_weights)):
        raise E.MismatchedInputs("the weighted metric needs one finite weight of at least 0 per dimension")
    if c.level is not None and not 0 < c.level < 1:
        raise E.InvalidIntervals(f"an interval level must be between 0 and 1, not {c.level}")
    if cv := c.cross_validation:
        if not cv.fractions:
            raise E.InvalidFraction("cross validation needs candidate fractions")
        for f in cv.fractions:
            check_fraction(f)
        if cv.folds is not None and cv.folds < 2:
            raise E.InvalidNumericValue(f"cross validation needs at least 2 folds, not {cv.folds}")
    if c.auto_converge is not None and not (math.isfinite(c.auto_converge) and c.auto_converge > 0):
        raise E.InvalidTolerance(f"the tolerance must be positive and finite, not {c.auto_converge}")
    if c.surface_mode == "interpolation" and c.cell is not None:
        if not (math.isfinite(c.cell) and 0 < c.cell <= 1):
            raise E.InvalidCell(f"the cell size must be in (0, 1], not {c.cell}")
        if c.interpolation_vertices is not None and (need := required_vertices(c.fraction, c.cell, c.dimensions)) > c.interpolation_vertices:
            raise E.InsufficientVertices(f"{need} vertices are needed, the limit is {c.interpolation_vertices}")
    if c.adapter == "streaming":
        if c.chunk_size < 10:
            raise E.InvalidChunkSize(f"the chunk size must be at least 10, not {c.chunk_size}")
        if not 0 <= c.overlap < c.chunk_size:
            raise E.InvalidOverlap(f"the overlap {c.overlap} must be below the chunk size {c.chunk_size}")
    if c.adapter == "online":
        if c.window_capacity < 3:
            raise E.InvalidWindowCapacity(f"the window must hold at least 3 points, not {c.window_capacity}")
        if not 2 <= c.min_points <= c.window_capacity:
            raise E.InvalidMinPoints(f"the least number of points must be from 2 to {c.window_capacity}, not {c.min_points}")
    if c.strict and c.adapter != "batch" and (c.cross_validation or c.wants_errors):
        raise E.UnsupportedFeature(f"the {c.adapter} adapter has no cross validation and no intervals")
