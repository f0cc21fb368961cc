"""Operators of a training-data pipeline; nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel with the job: executors need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
