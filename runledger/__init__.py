"""Pipeline reconciliation and run-health analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors get the few Arrow functions by value, so the package need not be
# installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
