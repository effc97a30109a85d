"""Retrieval, evaluation and telemetry analytics over text corpora, as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to Python workers by value, so that a job runs
# whether or not the package is installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
