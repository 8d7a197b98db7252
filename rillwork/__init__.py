"""Resource-efficiency analytics on Spark: typed sources, long facts, entity tables, screens and effects."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# functions that run in Python workers travel with the plan, so the executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
