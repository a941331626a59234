"""Corrected baseline values and removal of patients registered twice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import join_null_safe

CORRECTION_KEYS = ("ID_original", "Visit_date")


def apply_correction(
    baseline: DataFrame,
    correction: DataFrame | None,
    keys: Sequence[str] = CORRECTION_KEYS,
    target: str = "HAQ0",
    corrected: str = "HAQ_corrected",
    keep_original: bool = False,
    repeated: str = "repeat",
) -> DataFrame:
    """Overwrite ``target`` where a correction exists; without a table nothing changes.

    Repeated keys in the correction table repeat the baseline row, or with ``repeated="error"`` stop the job
    that reads the result; ``checks.key_repeats`` lists them.
    """
    if repeated not in ("repeat", "error"):
        raise ValueError("repeated must be 'repeat' or 'error'")
    if correction is None:
        return baseline.withColumn(f"{target}_original", F.col(target)) if keep_original else baseline
    fixes = correction.select(*keys, corrected)
    if repeated == "error":
        # One row per key stays, and the check is part of the value it gives.
        text = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
        known = F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated correction: "), text)).cast(fixes.schema[corrected].dataType))
        fixes = fixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.first(corrected).alias(corrected))
        fixes = fixes.select(*keys, known.otherwise(F.col(corrected)).alias(corrected))
    joined = join_null_safe(baseline, fixes, keys, "left").withColumn(f"{target}_original", F.col(target))
    fixed = joined.withColumn(target, F.coalesce(corrected, f"{target}_original")).drop(corrected)
    return fixed if keep_original else fixed.drop(f"{target}_original")


def correction_count(corrected: DataFrame, site: str, target: str = "HAQ0") -> DataFrame:
    """Rows of one site whose known value was changed by the correction.

    Takes the frame of ``apply_correction(keep_original=True)``.  An unknown value before or
    after does not count.
    """
    changed = (F.col("Code") == site) & (F.col(f"{target}_original") != F.col(target))
    return corrected.agg(F.count_if(changed).alias("num_replaced"))


def duplicate_pairs(correction: DataFrame) -> DataFrame:
    """Distinct patients per known pair."""
    return correction.where("pair_id IS NOT NULL").select("ID_original", "pair_id").distinct()


def pair_audit(correction: DataFrame) -> DataFrame:
    """Pairs with more than one patient."""
    return duplicate_pairs(correction).groupBy("pair_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def slice_min(df: DataFrame, by: str, value: str) -> DataFrame:
    """Rows that hold the smallest ``value`` of their group, ties kept."""
    lowest = df.groupBy(by).agg(F.min(value).alias(value))
    return join_null_safe(df, lowest, [by, value], "left_semi")


def ids_to_drop(correction: DataFrame) -> DataFrame:
    """Patients that are not the lowest id of any of their pairs."""
    pairs = duplicate_pairs(correction)
    kept = slice_min(pairs, "pair_id", "ID_original")
    return pairs.select("ID_original").subtract(kept.select("ID_original"))


def drop_ids(baseline: DataFrame, ids: DataFrame) -> DataFrame:
    """Baseline without the listed patients; rows without an id stay, and stay out of the join."""
    known = F.col("ID_original").isNotNull()
    return baseline.where(known).join(ids, "ID_original", "left_anti").unionByName(baseline.where(~known))


def dedup_baseline(baseline: DataFrame, correction: DataFrame | None) -> DataFrame:
    return baseline if correction is None else drop_ids(baseline, ids_to_drop(correction))
