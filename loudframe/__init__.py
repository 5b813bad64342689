"""Loudness and gain analytics for large signal collections, built on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the plan, so executors do not need the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
