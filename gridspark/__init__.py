"""gridspark: Spark-native operators for gridded environmental time series.

Functions that run in Python workers travel to the executors by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
