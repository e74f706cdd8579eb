"""Corpus preparation on Spark: thirteen operators over documents, pages and vectors. Nothing else in the library imports it."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of this package on their path
