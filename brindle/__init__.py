"""Brindle: DataFrame-in, DataFrame-out operators on Spark."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors as code, so it needn't be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
