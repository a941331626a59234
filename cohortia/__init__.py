"""Cohort analytics and risk modelling as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Task functions travel to the executors whole, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
