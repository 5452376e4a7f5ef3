"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions that run on executors are shipped by value, so that workers need numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
