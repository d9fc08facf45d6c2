"""Spark-native model-drift and training-data analytics."""

import sys

from pyspark import cloudpickle

from driftloom.config import (
    AlertBudgetConfig,
    ClusterConfig,
    DriftConfig,
    GateConfig,
    LoopConfig,
    SynthesisConfig,
    TrainingConfig,
)

__all__ = [
    "AlertBudgetConfig",
    "ClusterConfig",
    "DriftConfig",
    "GateConfig",
    "LoopConfig",
    "SynthesisConfig",
    "TrainingConfig",
]

# Executors need no copy of this package: task functions travel with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
