"""Sending models to the executors, which need no copy of the package to read them."""

from __future__ import annotations

import pickle

from pyspark import Broadcast, cloudpickle
from pyspark.sql import SparkSession


def shipped(spark: SparkSession, value) -> Broadcast:
    """Broadcast a small object together with its classes."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(shared: Broadcast):
    return pickle.loads(shared.value)
