"""Operators for preparing training data: deduplication, filtering, mixing, sharding.

Functions of this package are sent to Python workers by value, so a job also
runs where the workers cannot import the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
