"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get these functions by value: executors need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
