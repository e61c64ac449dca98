"""tracemill: log parsing, detection, mining and query operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need
# not have this package on their own path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
