"""Local regression smoothing for DataFrames, and operators for training-data pipelines."""

from driftline.api import Smoothed, Smoother, SmootherBuilder, format_result, register_smooth
from driftline.config import CrossValidation, SmootherConfig
from driftline.errors import SmootherError

__all__ = ["CrossValidation", "Smoothed", "Smoother", "SmootherBuilder", "SmootherConfig", "SmootherError", "format_result", "register_smooth"]
