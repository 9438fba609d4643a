"""Inference-log analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value, so these do not need the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
