"""Functions that run on executors are shipped by value, so that workers need not have this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["lexarray"])
