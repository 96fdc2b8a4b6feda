"""Analytics for bus recordings, and operators for training data."""

import sys

from pyspark import cloudpickle

__version__ = "0.3.0"

# functions travel to Python workers whole, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
