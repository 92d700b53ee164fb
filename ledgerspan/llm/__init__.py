"""Operators for large-scale text corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of this subpackage travel to Python workers by value, so executors need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
