"""Frequency, missingness and baseline tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import col, flag, is_missing
from ..functions.tails import chi_square_tail, f_tail
from ..session import cut_lineage
from .profile import value_counts


def freq_table(df: DataFrame, column: str, by: Sequence[str]) -> DataFrame:
    """Count and percent of each known value within each group."""
    counts = df.where(col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*by))
    return counts.withColumn("percent", share)


def flag_at_most(df: DataFrame, column: str, limit: float, name: str) -> DataFrame:
    """1 where the value is at most the limit, 0 above, unknown where it is missing."""
    return df.withColumn(name, flag(F.col(column) <= limit).cast("bigint"))


def missingness(df: DataFrame, columns: Sequence[str], by: str = "split") -> DataFrame:
    """Variables with missing values per group: count and percent to one decimal."""
    counted = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("__rows"), *[F.count_if(is_missing(df, name)).alias(name) for name in columns]
    )
    long = counted.unpivot([by, "__rows"], [col(name) for name in columns], "variable", "missing_count")
    percent = F.bround(100.0 * F.col("missing_count") / F.col("__rows"), 1)
    return long.where("missing_count > 0").select(by, "variable", "missing_count", percent.alias("missing_percent"))


def table_one_continuous(df: DataFrame, columns: Sequence[str], strata: str = "split") -> DataFrame:
    """Mean and SD per stratum with the equal-variance one-way F test across strata.

    One row per stratum holds all moments, so the data is read once and never multiplied by
    the number of variables.
    """
    moments = []
    for name in columns:
        value = F.when(~is_missing(df, name), col(name).cast("double"))
        moments.append(
            F.struct(
                F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")
            ).alias(name)
        )
    wide = df.where(F.col(strata).isNotNull()).groupBy(strata).agg(*moments)
    long = wide.unpivot([strata], [col(name) for name in columns], "variable", "m").select(
        strata, "variable", "m.n", "m.mean", "m.sd"
    )
    used = long.where("n > 0")
    overall = used.groupBy("variable").agg(
        F.sum("n").alias("total"),
        F.count(F.lit(1)).alias("groups"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum((F.col("n") - 1) * F.coalesce(F.pow("sd", F.lit(2)), F.lit(0.0))).alias("within"),
    )
    # One row per variable: bounded by the schema.
    spread = used.join(F.broadcast(overall), "variable")
    between = spread.groupBy("variable", "total", "groups", "within").agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), F.lit(2))).alias("between")
    )
    df1, df2 = F.col("groups") - 1, F.col("total") - F.col("groups")
    ratio = F.try_divide(F.try_divide("between", df1), F.try_divide("within", df2))
    tests = between.select("variable", ratio.alias("f_stat"), df1.alias("df1"), df2.alias("df2")).withColumn(
        "p_value", f_tail("f_stat", "df1", "df2")
    )
    return long.join(F.broadcast(tests), "variable", "left")


def table_one_categorical(
    df: DataFrame, columns: Sequence[str], strata: str = "split", values: Sequence[str] | None = None
) -> DataFrame:
    """Count and percent of each level per stratum with the chi-square test across strata.

    The strata are those of the data unless given.  Missing values and rows without a stratum take
    no part.  Two levels in two strata get the continuity correction.
    """
    # One row per level and stratum, written once: the strata, the table and the tests all come from it.
    every = cut_lineage(value_counts(df, columns, by=[strata]))
    if values is None:
        values = sorted(row["value"] for row in every.where(col(strata).isNotNull()).select(col(strata).cast("string").alias("value")).distinct().collect())
    values = list(values)
    if not values:
        raise ValueError(f"no row has a {strata}")
    counts = every.where(F.col("value").isNotNull())
    table = counts.groupBy("variable", F.col("value").alias("level")).pivot(strata, values).agg(F.sum("n"))
    table = table.na.fill(0, values)
    totals = table.groupBy("variable").agg(
        F.count(F.lit(1)).alias("levels"), F.map_from_arrays(_literals(values), _sums(values)).alias("of_stratum")
    )
    # One row per variable: bounded by the schema.
    cells = table.join(F.broadcast(totals), "variable").select(
        "variable",
        "level",
        "levels",
        F.size(F.map_filter("of_stratum", lambda _, n: n > 0)).alias("strata"),
        _total([F.col("of_stratum")[v] for v in values]).alias("total"),
        _total([col(v) for v in values]).alias("level_n"),
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(v).alias(strata), col(v).alias("n"), F.col("of_stratum")[v].alias("stratum_n"))
                    for v in values
                ]
            )
        ),
    )
    cells = cells.where("stratum_n > 0")
    expected = F.col("stratum_n") * F.col("level_n") / F.col("total")
    gap = F.abs(F.col("n") - expected)
    two_by_two = (F.col("levels") == 2) & (F.col("strata") == 2)
    gap = gap - F.when(two_by_two, F.least(F.lit(0.5), gap)).otherwise(0.0)
    free = (F.col("levels") - 1) * (F.col("strata") - 1)
    tests = cells.groupBy("variable", free.alias("df")).agg(F.sum(gap * gap / expected).alias("statistic"))
    tests = tests.select("variable", "df", F.when(F.col("df") > 0, F.col("statistic")).alias("chi2"))
    tests = tests.withColumn("p_value", chi_square_tail("chi2", "df"))
    percent = 100.0 * F.col("n") / F.col("stratum_n")
    rows = cells.select("variable", "level", strata, "n", percent.alias("percent"))
    return rows.join(F.broadcast(tests), "variable")


def _literals(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _sums(values: Sequence[str]) -> Column:
    return F.array(*[F.sum(col(v)) for v in values])


def _total(columns: Sequence[Column]) -> Column:
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total
