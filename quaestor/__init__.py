"""Quaestor: the data side of document question answering, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the job, so the Python workers of a
# cluster need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
