"""Column profiles: distinct values, missing counts, cardinality, near-zero variance, pruning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import heavy
from ..functions.nulls import FLOATING, INTEGRAL, col, is_missing, nan_as_null

MAX_LEVELS = 10
FREQ_CUT = 95 / 5
UNIQUE_CUT = 10.0

# Columns of the registry extract that are never predictors.
EXCLUDED_COLUMNS = """
region_id center_id Visit_date brand_name ttt_startDate ttt_stopDate ttt_course
Date_birth Date_symptoms Date_diagnosis ID_original ID_ttt extraction_date_calc bmi
last_visit generic_name treatment_JAKi treatment_TNFi treatment_IL6 treatment_IL17
treatment_IL23 treatment_ABA treatment_RITX treatment_OMA ttt ID bts_index N dift tmp
stopreasonremission Stop_remission Stop_pregnancy stopreasonpregnancy Stop_ineffectiveness
stopreasonineffectiveness Stop_safety Stop_other stopreason treatment_duration Education
totalpatienYear stopany visitnumber year difft Prev_btsDMARD1 Prev_btsDMARD3 comorb_na
ConcDMARD_tot disease comorb Comorb_tobacco Comorb_tobacco_date lostFUDate cDAPSA
skin_VAS_max DAPSA DAPSA28 DAS28 DAS28CRP4v DAS28ESR4v DAS28CRP3v DAS28ESR3v CDAI HAQ ESR
RF seropositive AntiCCP DAS28ESR DAS28CRP concomitantCsDMARD peripheral_arthritis enthesitis
dactylitis axial_involvement uveitis colitis dapsa dapsa28 cdapsa skin_vas skin_vas_max pasi
sj66 tj68 skin_VAS CDAI24_10 has_remission_cdai has_followup treatment_duration_calc afterJaki
concomitantCsDMARD_tot
""".split()
EXCLUDED_PATTERNS = ["^EQ5", "^previous", "^SF36_", "^reasonStop", "^time", "_n$", "12$"]


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, columns without any left out; one pass."""
    columns = list(columns or df.columns)
    counted = df.agg(*[F.count_if(is_missing(df, name)).alias(name) for name in columns])
    return counted.unpivot([], [col(name) for name in columns], "variable", "n_missing").where("n_missing > 0")


def value_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per value of each column as (variable, value, n), NULL among the values.

    Whole numbers, floating numbers and everything else are counted in their own type and
    turned to text afterwards, when there is one row per distinct value.
    """
    families: dict[str, list[str]] = {"bigint": [], "double": [], "string": []}
    for name in columns:
        dtype = df.schema[name].dataType
        family = "bigint" if isinstance(dtype, INTEGRAL) else "double" if isinstance(dtype, FLOATING) else "string"
        families[family].append(name)
    counted = None
    for family, names in families.items():
        if not names:
            continue
        values = df.select(*by, *[col(name).cast(family).alias(name) for name in names])
        long = values.unpivot(list(by), [col(name) for name in names], "variable", "value")
        part = long.groupBy(*by, "variable", "value").agg(F.count(F.lit(1)).alias("n"))
        part = part.withColumn("value", F.col("value").cast("string"))
        counted = part if counted is None else counted.unionByName(part)
    return counted


def profile_cardinality(df: DataFrame, max_levels: int = MAX_LEVELS) -> DataFrame:
    """Numeric columns with at most ``max_levels`` distinct values, NULL counted as one.

    A sketch over all numeric columns rules out those far above the limit; only the others are
    counted exactly.
    """
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    sketch = df.agg(*[F.approx_count_distinct(col(name), 0.05).alias(name) for name in numeric]).first()
    near = [name for name in numeric if sketch[name] <= 2 * max_levels]
    if not near:
        return df.sparkSession.createDataFrame([], "variable string, unique_values bigint")
    values = value_counts(df, near).groupBy("variable").agg(F.count(F.lit(1)).alias("unique_values"))
    return values.where(F.col("unique_values") <= max_levels)


def classify_columns(df: DataFrame, max_levels: int = MAX_LEVELS) -> dict[str, str]:
    """'categorical' for every non-numeric column and few-valued numeric one, else 'continuous'."""
    few = {row["variable"] for row in profile_cardinality(df, max_levels).collect()}
    return {
        f.name: "continuous" if isinstance(f.dataType, T.NumericType) and f.name not in few else "categorical"
        for f in df.schema.fields
    }


def level_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per level of each column."""
    return value_counts(df, columns).withColumnsRenamed({"value": "level"})


def single_level_columns(levels: DataFrame) -> DataFrame:
    """Columns whose level table has one level only."""
    counted = levels.groupBy("variable").agg(F.count(F.lit(1)).alias("levels"))
    return counted.where("levels = 1").select("variable")


def near_zero_var(
    df: DataFrame,
    columns: Sequence[str],
    freq_cut: float = FREQ_CUT,
    unique_cut: float = UNIQUE_CUT,
    prescreen: bool = False,
) -> DataFrame:
    """Frequency ratio of the two commonest values, percent of distinct values, and the verdict.

    Missing values are not counted.  ``prescreen=True`` first drops columns that a sketch shows
    to have far more distinct values than ``unique_cut`` allows: they can only be kept, so a
    caller that wants the verdict alone saves shuffling their values.
    """
    columns = list(columns)
    spark = df.sparkSession
    if prescreen:
        sketch = df.agg(
            F.count(F.lit(1)).alias("__rows"),
            *[F.approx_count_distinct(col(name), 0.05).alias(name) for name in columns],
        ).first()
        limit = 2 * unique_cut / 100 * sketch["__rows"]
        columns = [name for name in columns if sketch[name] <= max(limit, 2)]
    schema = "variable string, freq_ratio double, percent_unique double, zero_var boolean, nzv boolean"
    if not columns:
        return spark.createDataFrame([], schema)
    floating = [name for name in columns if isinstance(df.schema[name].dataType, FLOATING)]
    values = value_counts(df.withColumns({name: nan_as_null(col(name)) for name in floating}), columns)
    known = F.col("value").isNotNull()
    # The rank filter also runs before the shuffle, so each task sends two rows per variable.
    top = values.where(known).withColumn(
        "__rank", F.row_number().over(Window.partitionBy("variable").orderBy(F.desc("n"), "value"))
    )
    top = (
        top.where("__rank <= 2")
        .groupBy("variable")
        .agg(
            F.max(F.when(F.col("__rank") == 1, F.col("n"))).alias("first"),
            F.max(F.when(F.col("__rank") == 2, F.col("n"))).alias("second"),
        )
    )
    sizes = values.groupBy("variable").agg(F.sum("n").alias("rows"), F.count_if(known).alias("distinct"))
    joined = sizes.join(top, "variable", "left")
    ratio = F.when(F.col("second").isNull(), F.lit(0.0)).otherwise(F.col("first") / F.col("second"))
    unique = 100.0 * F.col("distinct") / F.col("rows")
    zero = F.col("distinct") <= 1
    return joined.select(
        "variable",
        ratio.alias("freq_ratio"),
        unique.alias("percent_unique"),
        zero.alias("zero_var"),
        (((ratio > freq_cut) & (unique <= unique_cut)) | zero).alias("nzv"),
    )


def near_zero_names(df: DataFrame, columns: Sequence[str], counters: int = heavy.COUNTERS) -> list[str]:
    """Names of the columns to drop, in order: metadata, at most one row per column.

    The verdict follows from each column's leading values, counted exactly; only columns that they leave
    open have all their values counted.
    """
    columns = list(columns)
    verdicts = {name: heavy.near_zero(found, FREQ_CUT, UNIQUE_CUT) for name, found in heavy.leading_values(df, columns, counters).items()}
    open_ = [name for name, verdict in verdicts.items() if verdict is None]
    verdicts |= {row["variable"]: row["nzv"] for row in near_zero_var(df, open_, prescreen=True).collect()}
    return [name for name in columns if verdicts[name]]


def drop_types(df: DataFrame, types: Sequence[type] = (T.DateType, T.TimestampType, T.TimestampNTZType)) -> DataFrame:
    """Drop columns by runtime type."""
    return df.select(*[col(f.name) for f in df.schema.fields if not isinstance(f.dataType, tuple(types))])


def prune_columns(
    df: DataFrame, names: Sequence[str] = EXCLUDED_COLUMNS, patterns: Sequence[str] = EXCLUDED_PATTERNS
) -> DataFrame:
    """Drop columns by name and by name pattern."""
    dropped = set(names)
    kept = [name for name in df.columns if name not in dropped and not any(re.search(p, name) for p in patterns)]
    return df.select(*[col(name) for name in kept])
