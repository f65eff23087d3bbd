"""Evaluation, monitoring and streaming of scored event tables on Spark."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in tasks travel by value, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
