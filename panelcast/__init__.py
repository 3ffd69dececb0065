"""Panel time-series analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
