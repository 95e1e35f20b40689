"""Spark operators for experiment studies on large sets of small graphs."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their module: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
