"""tidemark: guarded change-data replication jobs on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so that executors need
# no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
