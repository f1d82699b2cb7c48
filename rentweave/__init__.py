"""rentweave: property-listing analytics as PySpark DataFrame transforms."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers travel to executors by value, so that the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
