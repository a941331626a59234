"""Session settings and the reliable cut point used by iterative jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A course, patient or site may hold a large part of all rows.  Splitting its
    # join partition is worth the extra exchange a later grouping then needs.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings the operators count on."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the benchmark; a cluster job brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("cohortia")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Plans are built faster without the call site of every column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master, where
    driver and executors share one disk, falls back to a fresh folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="cohortia-checkpoint-")
    context.setCheckpointDir(configured)
    return context.getCheckpointDir()


def bucketed(df: DataFrame, key: str, parts: int | None = None) -> DataFrame:
    """``df`` written once into the shared folder, bucketed and sorted by ``key``.

    Tables with the same key and number of buckets are joined on it without an exchange, and a lost
    executor costs a bucket's file to read again.
    """
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    # Rows come to the writer by bucket, so each bucket is one file.
    dealt = df.repartition(parts, f"`{key}`")
    dealt.write.bucketBy(parts, key).sortBy(key).option("path", f"{checkpoint_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def stored(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder, as columns: a step that reads a few of them reads no others."""
    path = f"{checkpoint_dir(df.sparkSession)}/stored_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared folder; executor loss cannot undo it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
