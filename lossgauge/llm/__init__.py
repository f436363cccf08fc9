"""Operators for training corpora. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# tasks get these modules by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
