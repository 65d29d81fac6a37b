"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Task functions travel to the executors by value, so that only this driver needs the package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
