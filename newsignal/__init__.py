"""News text and daily price bars to model-ready signals, on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value, so executors need no copy of
# this package and no particular working directory.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
