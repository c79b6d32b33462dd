"""Spark-native analytics over large typed binary data.

Functions of this package are pickled by value, so that executors need no
installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
