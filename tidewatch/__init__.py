"""User-behaviour analytics on access logs and call logs, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions run in Python workers travel with the job, so executors need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
