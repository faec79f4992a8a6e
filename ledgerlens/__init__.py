"""Document-audit analytics on PySpark."""

import sys

from pyspark import cloudpickle

# executors get the functions themselves: the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
