"""Spark-native source and text insight engine.

Functions that run on executors are shipped by value, so a cluster needs no copy of this package
beside the driver's.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
