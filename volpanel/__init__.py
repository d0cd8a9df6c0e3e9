"""PySpark-native analytics for option-market panels and other keyed daily panels."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so a task does not
# need the package installed (or the driver's working directory) to run them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
