"""Fleet telemetry analytics on Spark DataFrames and Structured Streaming."""

import sys

from pyspark import cloudpickle

# Python tasks carry the library's few functions with them, so that executors need no copy of
# the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
