"""Spark-native analytics for large panels of time series and two-forecaster routing."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# executors get the small helper functions by value, so the package need not be installed on them
cloudpickle.register_pickle_by_value(sys.modules[__name__])
