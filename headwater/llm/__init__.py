"""Operators for preparing training text. Nothing else in the library imports them."""

from pyspark import cloudpickle

import headwater

# Task functions travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(headwater)
