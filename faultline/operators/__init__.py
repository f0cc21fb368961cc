import sys

from pyspark import cloudpickle

# Functions of this package travel with the job: executors need no copy of the library on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
