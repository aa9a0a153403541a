"""photonlake: photo-library analytics expressed as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions handed to executors travel by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
