"""cohortloom: cohort analytics as Spark jobs.

Operators take and return DataFrames.  Row-level work stays on Spark; only
dictionaries, coefficient vectors and small matrices of sums reach the driver.
"""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
