"""Small helpers shared by the operators."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


# Rows go to Python in batches of so many bytes: long texts would otherwise fill a worker ten thousand at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; from now on the session hands rows to Python in small batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{folder}/{name}.parquet")


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def whole_text(name: str = "text") -> Column:
    """The text of a row; a missing text counts as an empty one."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def process_cache(name: str, make: Callable[[], object]) -> object:
    """An object that the tasks of a Python worker build once and share, until they ask for another one.

    A worker outlives the stages of a pipeline; what an earlier one kept must not stay beside the new.
    """
    home = sys.modules.setdefault("_cohortia_llm_worker", types.ModuleType("_cohortia_llm_worker"))
    if not hasattr(home, name):
        for other in [n for n in vars(home) if not n.startswith("__")]:
            delattr(home, other)
        setattr(home, name, make())
    return getattr(home, name)


def stored(df: DataFrame, what: str = "part") -> DataFrame:
    """``df`` written once into the shared checkpoint folder and read back.

    Later steps start from the files, so a lost executor costs no earlier step, and the rows are
    the same in every step that reads them.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def batch(schema: pa.Schema, columns: dict) -> pa.RecordBatch:
    """One Arrow batch out of plain lists or arrays."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)


def buckets_for(n: int, per_bucket: int) -> int:
    """How many hash buckets hold ``n`` units at about ``per_bucket`` each; at least one."""
    return max(1, -(-n // per_bucket))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name
