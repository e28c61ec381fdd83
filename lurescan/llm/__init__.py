"""Operators that prepare documents for language-model training."""

import sys

from pyspark import cloudpickle

# tasks get these functions with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
