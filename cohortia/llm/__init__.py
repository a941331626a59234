"""Operators of a training-data pipeline; nothing else in the library imports this subpackage.

Functions that run in tasks travel to the executors by value, so executors need Spark's Python and
the third-party libraries, but no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
