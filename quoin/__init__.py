"""Analytics and retrieval over structured text, as DataFrame operators on Spark."""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
