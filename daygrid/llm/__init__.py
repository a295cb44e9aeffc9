"""Operators for training-data pipelines. Nothing outside this folder and its tests imports it.

Functions that run in Python workers are shipped by value, so executors need no copy of the package.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
