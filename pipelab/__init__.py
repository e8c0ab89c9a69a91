"""Spark-native building, scoring and comparing of tabular model pipelines."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
