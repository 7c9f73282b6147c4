"""gramlode: indexed regular-expression search over text corpora, on Spark."""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
