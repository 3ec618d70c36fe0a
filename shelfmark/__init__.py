"""Spark operators over file catalogs: scan, classify, dedupe, rename, plan, undo.

Every operator is a function from DataFrames to DataFrames. Nothing here moves
files; a plan is a table, and applying it produces the next catalog.
"""

import sys

from pyspark import cloudpickle

# The few Python helpers that run inside tasks travel with the job, so
# executors do not need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
