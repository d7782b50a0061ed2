"""Spark-native analytics: block vector quantisation, image quality, and data preparation."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: a cluster needs no copy of this package on its workers.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
