"""Operators for preparing training text; nothing outside this folder imports them.

Functions for tasks are sent by value, so workers need this package on no path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
