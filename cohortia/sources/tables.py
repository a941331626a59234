"""Reading the input tables; gated writing of results, metrics and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.nulls import col

COHORT_TABLES = ("visits", "baseline", "events")
METRIC_SCHEMA = "stage string, metric string, value string"


def load_cohort(spark: SparkSession, path: str, tables: Sequence[str] = COHORT_TABLES) -> dict[str, DataFrame]:
    """The tables of a study from one folder of parquet tables."""
    return {name: spark.read.parquet(f"{path}/{name}.parquet") for name in tables}


def load_correction(spark: SparkSession, path: str | None = None) -> DataFrame | None:
    """The optional correction table, keyed like the baseline table."""
    if not path:
        return None
    table = spark.read.parquet(path).withColumnRenamed("ID", "ID_original")
    return table.withColumn("Visit_date", F.to_date("Visit_date"))


@dataclass(frozen=True)
class ExportConfig:
    """Where results go, under which run, and which kinds may be written; nothing is written by default.

    A run writes each of its results once: a second attempt under the same name replaces the first.
    """

    folder: str = ""
    derived_outputs: bool = False
    model_artifacts: bool = False
    run: str = "run"
    formats: Mapping[str, str] = field(default_factory=dict)


def export(df: DataFrame, name: str, config: ExportConfig) -> bool:
    """Write a derived table if that is allowed; parquet unless the table is listed as csv."""
    if not config.derived_outputs:
        return False
    writer = df.write.mode("overwrite")
    if config.formats.get(name, "parquet") == "csv":
        writer.option("header", True).csv(f"{config.folder}/{name}.csv")
    else:
        writer.parquet(f"{config.folder}/{name}.parquet")
    return True


def metrics_table(stage: str, df: DataFrame) -> DataFrame:
    """A small result table as (stage, metric, value) rows, text columns naming the metric."""
    names = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    values = [name for name in df.columns if name not in names]
    prefix = F.concat_ws(".", *[col(name) for name in names]) if names else F.lit("")
    long = df.select(prefix.alias("__prefix"), *[col(name).cast("string").alias(name) for name in values])
    long = long.unpivot(["__prefix"], [col(name) for name in values], "__name", "value")
    metric = F.when(F.col("__prefix") == "", F.col("__name")).otherwise(F.concat_ws(".", "__prefix", "__name"))
    return long.select(F.lit(stage).alias("stage"), metric.alias("metric"), "value")


def append_metrics(stage: str, df: DataFrame, config: ExportConfig) -> bool:
    """Put a result table among the metrics; those of other runs and stages stay, an earlier attempt at this one goes."""
    if not config.folder:
        return False
    table = metrics_table(stage, df).withColumn("run", F.lit(config.run))
    writer = table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "stage")
    writer.parquet(f"{config.folder}/metrics.parquet")
    return True


MANIFEST_SCHEMA = "run string, part string, n_rows bigint, digest decimal(38,0)"


def _facts(part: str, df: DataFrame) -> tuple:
    """Rows of a table, and a sum over their hashes that does not depend on the order."""
    digest = F.sum(F.xxhash64(*[col(c) for c in df.columns]).cast("decimal(20,0)"))
    row = df.agg(F.count(F.lit(1)).alias("n"), digest.cast("decimal(38,0)").alias("digest")).first()
    return part, row["n"], row["digest"]


def save_model(trees: DataFrame, settings: Mapping, path: str, config: ExportConfig) -> bool:
    """Write a model's trees and settings if that is allowed, and last the manifest that makes them a model."""
    if not config.model_artifacts:
        return False
    spark = trees.sparkSession
    trees.write.mode("overwrite").parquet(f"{path}/trees.parquet")
    rows = [(name, float(value)) for name, value in settings.items()]
    spark.createDataFrame(rows, "name string, value double").write.mode("overwrite").parquet(f"{path}/settings.parquet")
    # Facts are those of the files, so the manifest vouches for what a reader will find.
    facts = [_facts(part, spark.read.parquet(f"{path}/{part}.parquet")) for part in ("trees", "settings")]
    spark.createDataFrame([(config.run, *f) for f in facts], MANIFEST_SCHEMA).coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest.parquet")
    return True


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, float]]:
    """Trees and settings of a saved model; one whose parts are not those of its manifest is refused."""
    try:
        manifest = {r["part"]: (r["part"], r["n_rows"], r["digest"]) for r in spark.read.parquet(f"{path}/manifest.parquet").collect()}
        parts = {part: spark.read.parquet(f"{path}/{part}.parquet") for part in ("trees", "settings")}
        whole = all(manifest.get(part) == _facts(part, table) for part, table in parts.items())
    except AnalysisException as missing:
        raise ValueError(f"no complete model in {path}") from missing
    if not whole:
        raise ValueError(f"the parts of the model in {path} do not belong together")
    settings = {row["name"]: row["value"] for row in parts["settings"].collect()}
    return parts["trees"], settings
