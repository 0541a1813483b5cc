"""Behavioural profiling of large flow tables, written as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

from flowprofile.config import DEFAULT_FEATURES, PipelineConfig

# Functions that run inside tasks travel with the job: the executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["DEFAULT_FEATURES", "PipelineConfig"]
__version__ = "0.1.0"
