"""tracewell: query-log diagnosis on Spark DataFrames.

Operators take DataFrames and return DataFrames; nothing here starts a job
unless its docstring says so.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the task, so that executors
# need no copy of this package and a session may start in any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
