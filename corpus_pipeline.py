"""A training-data pipeline: each stage works on all documents its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as
the next one's documents.  All but the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortia.llm.common import col, free_name, stored, table
from cohortia.llm.decontaminate import find_regions
from cohortia.llm.neardup import near_duplicates
from cohortia.llm.packing import pack
from cohortia.llm.suffixes import remove_repeats
from cohortia.llm.toxicity import fit_toxicity, score_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under one half; empty and missing texts are scored too."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    scored = score_toxicity(docs, model, column=score)
    return scored.where(col(score) < 0.5).select(*[col(c).alias(c) for c in docs.columns])


def near_duplicate_groups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word shingle sets with similarity 0.8 or more: the smallest id.

    Documents without words, or without an id, have no group and stay.
    """
    found = near_duplicates(docs, width=5, percent=80)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that earlier documents have; ``n_chars`` follows the text.

    Every document stays, if need be with an empty text; a missing text becomes an empty one.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    marker = free_name(docs, "row")
    found = remove_repeats(docs.withColumn(marker, F.lit(0)), width=50, carry=[marker, *others])
    columns = {c: F.col("carried").getField(c) for c in others}
    columns |= {"doc_id": F.col("doc_id"), "text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return found.select(*[columns[c].cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a region that a benchmark probe matches; empty and missing texts stay."""
    regions = free_name(docs, "regions")
    found = find_regions(docs, table(spark, sf_dir, "benchmark"), column=regions)
    return found.where(F.size(col(regions)) == 0).select(*[col(c).alias(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicate_groups),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

# No stage but the joins between them can be said in SQL; the tests hold each against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
