"""Training-data operators: each module holds one operator, its query and, where SQL can say it, its SQL.

Nothing else in the library imports this package.  The functions that run inside Spark's Python
workers are shipped with the job, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
