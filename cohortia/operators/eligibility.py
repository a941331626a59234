"""Derived covariates and cohort exclusions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import capped, holds, is_in, lookup, not_in

MAX_YEARS = 2.0


def override_by_site(df: DataFrame, target: str, source: str, dates: Mapping[str, str], site: str = "Code"):
    """``target`` is ``source`` with the date of some sites replaced."""
    value = F.col(source)
    for name, day in dates.items():
        value = F.when(is_in(F.col(site), [name]), F.lit(day).cast("date")).otherwise(value)
    return df.withColumn(target, value)


def site_cutoff_filter(df: DataFrame, name: str, start: str, cutoff: str, site: str = "Code") -> DataFrame:
    """At one site keep only rows that start by the cutoff; an unknown start there is dropped."""
    at_site = is_in(F.col(site), [name])
    return df.where(~at_site | (F.col(start) <= F.col(cutoff)))


def treatment_duration(df: DataFrame, extraction: str = "extraction_date_calc") -> DataFrame:
    """Years from start to stop, else loss to follow-up, else data extraction; at most two."""
    end = F.coalesce("ttt_stopDate", "lostFUDate", extraction)
    years = F.datediff(end, F.col("ttt_startDate")) / 365.25
    return df.withColumn("treatment_duration_calc", capped(years, MAX_YEARS))


def bmi(df: DataFrame, weight: str = "Weight", height: str = "Height") -> DataFrame:
    """Weight over squared height in metres; a height of zero gives no value."""
    metres = F.col(height) / 100
    return df.withColumn("BMI_recalc", F.try_divide(F.col(weight), metres * metres)).drop("BMI")


def with_disease(df: DataFrame, disease: str = "ra") -> DataFrame:
    return df.where(F.col("disease") == disease)


def after_introduction(
    df: DataFrame, years: Mapping[str, int], site: str = "Code", year: str = "year", name: str = "afterJaki"
) -> DataFrame:
    """1 if the row's year is at or after its site's introduction year, else 0.

    Three-valued: unknown where a missing site or year leaves the answer open.
    """
    where, when = F.col(site), F.col(year)
    introduced = lookup(where, years)
    open_site = where.isNull() & (when.isNull() | (when >= min(years.values())))
    open_year = introduced.isNotNull() & when.isNull()
    value = F.when(~(open_site | open_year), holds(when >= introduced).cast("bigint"))
    return df.withColumn(name, value)


def exclude_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Drop rows holding one of the values; rows without a value stay."""
    return df.where(not_in(F.col(column), values))


def map_groups(
    df: DataFrame,
    groups: Mapping[str, Sequence[str]],
    column: str = "generic_name",
    name: str = "treatment_group",
    trim: bool = True,
    flags: bool = True,
) -> DataFrame:
    """Label names by the first group listing them, with a boolean per group.

    ``trim`` ignores blanks around names on both sides.
    """
    value: Column = F.trim(column) if trim else F.col(column)
    member = {
        group: is_in(value, [drug.strip() if trim else drug for drug in drugs]) for group, drugs in groups.items()
    }
    label = F.lit(None).cast("string")
    for group in reversed(list(member)):
        label = F.when(member[group], group).otherwise(label)
    added = {f"treatment_{group}": test for group, test in member.items()} if flags else {}
    return df.withColumns({**added, name: label})


def keep_groups(df: DataFrame, groups: Sequence[str], name: str = "treatment_group") -> DataFrame:
    return df.where(F.col(name).isin(list(groups)))


def cohort_flow(df: DataFrame, steps: Mapping[str, Column]) -> DataFrame:
    """Rows before, removed and after for each exclusion in order, from one pass.

    ``steps`` names the condition under which a row is kept; unknown means removed.
    """
    names = list(steps)
    kept, counts = F.lit(True), [F.count(F.lit(1)).alias("__0")]
    for i, condition in enumerate(steps.values(), 1):
        kept = kept & holds(condition)
        counts.append(F.count_if(kept).alias(f"__{i}"))
    rows = [
        F.struct(
            F.lit(i).cast("bigint").alias("step_no"),
            F.lit(name).alias("step"),
            F.col(f"__{i - 1}").alias("n_before"),
            (F.col(f"__{i - 1}") - F.col(f"__{i}")).alias("n_removed"),
            F.col(f"__{i}").alias("n_after"),
        )
        for i, name in enumerate(names, 1)
    ]
    return df.agg(*counts).select(F.inline(F.array(*rows)))
