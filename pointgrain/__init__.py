"""Analytics over large tables of weighted numeric records, written as DataFrame functions."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in executors travel by value: executors need no copy of this package.
register_pickle_by_value(sys.modules[__name__])
