"""Categorical encodings and the feature array."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.nulls import FLOATING, col, lookup, nan_as_null
from .profile import level_table
from .rank import numbered_in_parts

MISSING_LEVEL = "missing"
MAX_LEVELS = 2000

# Columns encoded one column per level.
ENCODED_COLUMNS = [
    "treatment_group", "AntiCCPevernever", "Comorb_diabetes", "Comorb_hiv", "Comorb_hyperlipidemia",
    "Comorb_hypertension", "Comorb_inf", "Comorb_lung", "Comorb_malignancy", "Comorb_myocardial",
    "Comorb_neuropsy", "Comorb_other_cv", "Comorb_stroke", "Comorb_tobacco_ever_never", "GC", "GC_route", "HCQ",
    "LEF", "MTX", "MTX_delivery", "Other_DMARD", "PASI", "RFevernever", "SSZ", "Sex", "antiaggregant",
    "anticoagulant", "currentNSAIDS", "currentNSAIDScox", "delivery", "educational_status", "family_history",
    "pastNSAIDS", "pastNSAIDScox", "tsDMARD_schedule",
]

# Base variables of the reduced model.
REDUCED_MODEL = ["PGA", "TJC28", "Prev_btsDMARD", "HAQ0", "PhGA", "Age", "CDAI0", "CRP", "Pain", "AntiCCPevernever"]


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN to NULL in every floating column."""
    return df.select(
        *[
            nan_as_null(col(f.name)).alias(f.name) if isinstance(f.dataType, FLOATING) else col(f.name)
            for f in df.schema.fields
        ]
    )


def cast_bools(df: DataFrame) -> DataFrame:
    """TRUE / FALSE columns to 1.0 / 0.0."""
    return df.select(
        *[
            col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.BooleanType) else col(f.name)
            for f in df.schema.fields
        ]
    )


def fill_missing_level(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The listed columns that exist, as text with missing values as a level of their own."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: F.coalesce(col(name).cast("string"), F.lit(MISSING_LEVEL)) for name in present})


def collect_levels(df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS) -> dict[str, list]:
    """Known levels of each column: numbers by size, text by alphabet.

    Levels become column names or plan literals, so a column with more than ``limit`` of them
    is refused rather than collected.
    """
    columns = list(columns)
    levels: dict[str, list] = {name: [] for name in columns}
    if not columns:
        return levels
    known = level_table(df, columns).where("level IS NOT NULL").select("variable", "level")
    rows = known.limit(limit * len(columns) + 1).collect()
    for row in rows:
        levels[row["variable"]].append(row["level"])
    too_many = [name for name, found in levels.items() if len(found) > limit]
    if too_many or len(rows) > limit * len(columns):
        raise ValueError(f"more than {limit} levels: {too_many or columns}")
    for name, found in levels.items():
        numeric = isinstance(df.schema[name].dataType, T.NumericType)
        levels[name] = sorted(found, key=float) if numeric else sorted(found)
    return levels


def one_hot(
    df: DataFrame,
    columns: Sequence[str],
    levels: Mapping[str, Sequence] | None = None,
    limit: int = MAX_LEVELS,
) -> DataFrame:
    """Replace each column by one 1.0 / 0.0 column per level, named ``column.level``.

    Levels are those of the whole frame unless given.  Columns with a single level carry no
    information and stay as they are.  Each level becomes a column of the plan, so a column with more
    than ``limit`` of them is an error; raise the limit to encode it all the same.
    """
    levels = collect_levels(df, columns, limit) if levels is None else levels
    encoded = [name for name in columns if len(levels[name]) > 1]
    kept = [col(name) for name in df.columns if name not in encoded]
    dummies = [
        F.coalesce(col(name).cast("string") == F.lit(str(level)), F.lit(False)).cast("double").alias(f"{name}.{level}")
        for name in encoded
        for level in levels[name]
    ]
    return df.select(*kept, *dummies)


def ordinal_encode(
    df: DataFrame, columns: Sequence[str], levels: Mapping[str, Sequence] | None = None, base: int = 1
) -> DataFrame:
    """Codes in level order, starting at ``base``; missing stays missing.

    Without ``levels``, the distinct values of each column are numbered in a table of their own,
    numbers by size and text by alphabet, and joined: any number of levels will do.
    """
    if levels is None:
        return _encode_by_join(df, columns, base)
    codes = {name: {str(level): base + i for i, level in enumerate(levels[name])} for name in columns}
    if not columns:
        return df
    return df.withColumns(
        {
            name: (lookup(col(name).cast("string"), codes[name]) if codes[name] else F.lit(None)).cast("double")
            for name in columns
        }
    )


def _encode_by_join(df: DataFrame, columns: Sequence[str], base: int) -> DataFrame:
    """Codes from a level table that is distributed like any other."""
    known = level_table(df, columns).where("level IS NOT NULL").select("variable", F.col("level").cast("string").alias("level"))
    numeric = [name for name in columns if isinstance(df.schema[name].dataType, T.NumericType)]
    size = F.when(F.col("variable").isin(numeric), F.col("level").cast("double")) if numeric else F.lit(None).cast("double")
    # Levels are numbered across range partitions, so no task holds all levels of a column.
    levels_in_order = numbered_in_parts(known.distinct().withColumn("__size", size), ["variable"], ["__size", "level"], "__number")
    coded = levels_in_order.withColumn("code", (F.col("__number") + F.lit(base - 1)).cast("double"))
    out = df
    for i, name in enumerate(columns):
        level, code = f"__level{i}", f"__code{i}"
        one = coded.where(F.col("variable") == name).select(F.col("level").alias(level), F.col("code").alias(code))
        out = out.join(one, col(name).cast("string") == F.col(level), "left").withColumn(name, F.col(code)).drop(level, code)
    return out.select(*[col(c) for c in df.columns])


def binary_target(df: DataFrame, column: str) -> DataFrame:
    """The target as 0 / 1; any other known value stops the job."""
    value = col(column).cast("double")
    checked = F.when(value.isNull() | value.isin(0.0, 1.0), value.cast("bigint")).otherwise(
        F.raise_error(F.concat(F.lit(f"{column} must be 0 or 1, found "), value.cast("string"))).cast("bigint")
    )
    return df.withColumn(column, checked)


def expand_features(columns: Sequence[str], base: Sequence[str]) -> list[str]:
    """Columns that are one of the base variables or were encoded from one."""
    found: list[str] = []
    for name in base:
        found += [c for c in columns if c == name]
        found += [c for c in columns if re.match(re.escape(name) + r"[._]", c)]
    if not found:
        raise ValueError("none of the base variables is present")
    return list(dict.fromkeys(found))


def feature_subset(df: DataFrame, base: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Columns to keep plus those expanded from the base variables."""
    candidates = [name for name in df.columns if name not in keep]
    return df.select(*[col(name) for name in [*keep, *expand_features(candidates, base)]])


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    """All features as one array of doubles, missing values kept."""
    return df.withColumn(name, F.array(*[col(f).cast("double") for f in features]))


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def assert_same_features(left: Sequence[str], right: Sequence[str]) -> None:
    if list(left) != list(right):
        raise ValueError(f"feature sets differ: {sorted(set(left) ^ set(right))}")


def align(left: DataFrame, right: DataFrame, on: str = "row_id") -> DataFrame:
    """Two tables about the same rows, side by side by row id."""
    return left.join(right, on)


def unmatched_rows(left: DataFrame, right: DataFrame, on: str = "row_id") -> DataFrame:
    """Row counts of both tables and of the ids found in both; all three must agree."""
    ids = left.select(on, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(on, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    per_id = ids.groupBy(on).agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    return per_id.agg(
        F.sum("l").alias("left_rows"), F.sum("r").alias("right_rows"), F.sum(F.least("l", "r")).alias("matched_rows")
    )
