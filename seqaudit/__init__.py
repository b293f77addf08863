"""Audit of model predictions on DNA sequences, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Python workers receive this package's functions with the task, so they need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
