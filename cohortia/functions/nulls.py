"""Column helpers that keep three-valued missing-data rules Spark treats differently."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.DoubleType, T.FloatType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def col(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_in(c: Column, values: Iterable) -> Column:
    """Membership that is FALSE, not NULL, for a missing value."""
    return F.coalesce(c.isin(list(values)), F.lit(False))


def not_in(c: Column, values: Iterable) -> Column:
    """Exclusion that keeps missing values."""
    return ~is_in(c, values)


def holds(condition: Column) -> Column:
    """A filter condition as a plain boolean: NULL counts as FALSE."""
    return F.coalesce(condition, F.lit(False))


def flag(condition: Column) -> Column:
    """1 / 0 for a condition, NULL where the condition is unknown."""
    return F.when(condition, F.lit(1)).when(~condition, F.lit(0))


def capped(c: Column, limit: float) -> Column:
    """``least`` that leaves a missing value missing."""
    return F.when(c.isNotNull(), F.least(c, F.lit(limit)))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, and NaN too for floating columns."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return col(name).isNull() | F.isnan(col(name))
    return col(name).isNull()


def nan_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(float("nan")))


def add_months_strict(day: Column, months: int, clamp: bool = False) -> Column:
    """Same day ``months`` later; NULL where that month has no such day.

    ``clamp=True`` moves to the end of the month instead, as Spark does.
    """
    moved = F.add_months(day, months)
    if clamp:
        return moved
    return F.when(F.dayofmonth(moved) == F.dayofmonth(day), moved)


def lookup(c: Column, mapping: Mapping) -> Column:
    """Value of a small literal map, NULL for an unlisted or missing key."""
    entries = [F.lit(part) for pair in mapping.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), c)


def join_null_safe(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where a missing key matches a missing key; keys appear once."""
    keys = list(keys)
    renamed = right.withColumnsRenamed({key: f"__{key}" for key in keys})
    condition = F.lit(True)
    for key in keys:
        condition = condition & col(key).eqNullSafe(col(f"__{key}"))
    joined = left.join(renamed, condition, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__{key}" for key in keys])
