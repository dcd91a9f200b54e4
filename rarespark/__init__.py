"""Interpretable outlier analysis of tables on Spark."""

import sys

from pyspark import cloudpickle

from .config import FeatureEngineeringConfig, PreprocessConfig, RarityConfig
from .plans.detector import RarityDetector, RarityResult

__all__ = ["FeatureEngineeringConfig", "PreprocessConfig", "RarityConfig", "RarityDetector", "RarityResult"]

# Functions of this package travel to the workers with their code, so workers need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
