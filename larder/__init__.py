"""Customer-panel analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions sent to workers travel by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
