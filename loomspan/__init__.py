"""A Spark-native engine for turning short text records into a connected, reviewable corpus."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry the package's code along, so executors need no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
