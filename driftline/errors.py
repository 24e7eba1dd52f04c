"""Errors of configuration and data."""

from __future__ import annotations


class SmootherError(ValueError):
    """Base of all errors that a configuration or its input can raise."""


class EmptyInput(SmootherError):
    """There are no rows."""


class MismatchedInputs(SmootherError):
    """Predictor and response columns do not fit each other."""


class TooFewPoints(SmootherError):
    """A series has fewer rows than a fit needs."""


class InvalidNumericValue(SmootherError):
    """A value is null, NaN or infinite, or a number is out of its domain."""


class InvalidFraction(SmootherError):
    """A span fraction is not in (0, 1]."""


class InvalidIterations(SmootherError):
    """The number of iterations is out of range."""


class InvalidIntervals(SmootherError):
    """An interval level is not in (0, 1)."""


class InvalidTolerance(SmootherError):
    """A convergence tolerance is not positive and finite."""


class InvalidCell(SmootherError):
    """The cell size is not in (0, 1]."""


class InsufficientVertices(SmootherError):
    """The limit of vertices is below what span and cell size need."""


class InvalidChunkSize(SmootherError):
    """The chunk size is too small."""


class InvalidOverlap(SmootherError):
    """The overlap is not below the chunk size."""


class InvalidWindowCapacity(SmootherError):
    """The window of the online smoother is too small."""


class InvalidMinPoints(SmootherError):
    """The least number of points is out of range."""


class DuplicateParameter(SmootherError):
    """An option was set twice on a builder."""


class InvalidInput(SmootherError):
    """An option has a value that is not known."""


class UnsupportedFeature(SmootherError):
    """An option does not apply to the adapter (raised in strict mode only)."""
