"""Operators for preparing training text at scale, each with a registered query."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage that run in tasks travel with the task; executors need not have the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
