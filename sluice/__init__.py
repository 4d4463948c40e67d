"""A metadata-driven lakehouse flow engine on plain Spark."""

import sys

from pyspark import cloudpickle

# Python workers need not have this package installed: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
