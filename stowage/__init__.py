"""Stowage: catalog reconciliation, causal lineage, entity resolution and timed-text analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are shipped whole, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
