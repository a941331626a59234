"""Repeated visits: order within a course, calendar windows and the binary outcome."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import add_months_strict, holds, is_missing, join_null_safe
from .rank import numbered

COURSE = ("ID", "ttt_course")
REMISSION = 2.8
EARLIEST_MONTHS = 6
LATEST_MONTHS = 24


def visit_order(visits: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """Number the visits of each course by date, ties by ``visit_id``."""
    options = {} if hot_rows is None else {"hot_rows": hot_rows}
    return numbered(visits, COURSE, "Visit_date", "visit_id", "visit_order", **options)


def first_visits(visits: DataFrame) -> DataFrame:
    """The first visit of each course.

    The rank filter is applied before the shuffle as well (window group limit), so a course
    sends one row per task however many visits it has.
    """
    window = Window.partitionBy(*COURSE).orderBy(F.col("Visit_date").asc_nulls_last(), "visit_id")
    return visits.withColumn("__rank", F.row_number().over(window)).where("__rank = 1").drop("__rank")


def with_first(visits: DataFrame, start: str | None = None) -> DataFrame:
    """Add ``first_visit_id``, the id of the course's first visit, and its date as ``start`` if named.

    One aggregation with partial sums and one join on the course: a course of any size is one row
    per task in the first, and adaptive execution may split it in the second.
    """
    first = F.min(F.struct(F.col("Visit_date").isNull().alias("late"), "Visit_date", "visit_id")).alias("__first")
    facts = {"first_visit_id": F.col("__first.visit_id")} | ({start: F.col("__first.Visit_date")} if start else {})
    firsts = visits.groupBy(*COURSE).agg(first).select(*COURSE, *[value.alias(name) for name, value in facts.items()])
    return join_null_safe(visits, firsts, COURSE)


def followups(visits: DataFrame, where: Column | None = None) -> DataFrame:
    """Visits other than the first of their course.

    ``where`` restricts the visits returned (a calendar window, say) while first visits are found
    among all ``visits``; a ``first_visit_id`` that is there already is used.
    """
    known = "first_visit_id" in visits.columns
    rows = visits if known else with_first(visits)
    later = rows.where(F.col("visit_id") != F.col("first_visit_id"))
    later = later if where is None else later.where(where)
    return later if known else later.drop("first_visit_id")


def in_window(lo: int = EARLIEST_MONTHS, hi: int = LATEST_MONTHS, clamp: bool = False) -> Column:
    """start + lo months <= visit <= start + hi months."""
    start = F.col("ttt_startDate")
    return holds(
        F.col("Visit_date").between(add_months_strict(start, lo, clamp), add_months_strict(start, hi, clamp))
    )


def before_window(hi: int = EARLIEST_MONTHS, clamp: bool = False) -> Column:
    """start < visit < start + hi months."""
    start = F.col("ttt_startDate")
    return holds((F.col("Visit_date") > start) & (F.col("Visit_date") < add_months_strict(start, hi, clamp)))


def window_visits(
    visits: DataFrame, lo: int = EARLIEST_MONTHS, hi: int = LATEST_MONTHS, clamp: bool = False
) -> DataFrame:
    """Follow-up visits inside the outcome window."""
    return followups(visits, in_window(lo, hi, clamp))


def early_visits(visits: DataFrame, hi: int = EARLIEST_MONTHS, clamp: bool = False) -> DataFrame:
    """Follow-up visits with a score after the start and before the outcome window."""
    return followups(visits, before_window(hi, clamp) & ~is_missing(visits, "CDAI"))


def course_outcomes(
    visits: DataFrame, threshold: float = REMISSION, keys: Sequence[str] = COURSE, clamp: bool = False
) -> DataFrame:
    """Valid and remission visits per course, early and late, first visit left out.

    One conditional aggregation: counts over all visits, minus what the first visit added.
    Partial sums are combined before the shuffle, so a course of any size is one row per task.
    """
    scored = ~is_missing(visits, "CDAI")
    remission = holds(F.col("CDAI") <= threshold)
    late, early = in_window(clamp=clamp) & scored, before_window(clamp=clamp) & scored
    parts = {"late": late, "late_remission": late & remission, "early": early, "early_remission": early & remission}

    flagged = visits.select(
        *keys, "Visit_date", "visit_id", *[part.cast("bigint").alias(name) for name, part in parts.items()]
    )
    first = F.min(F.struct(F.col("Visit_date").isNull(), "Visit_date", "visit_id", *parts))
    counted = flagged.groupBy(*keys).agg(*[F.sum(name).alias(f"all_{name}") for name in parts], first.alias("first"))
    return counted.select(*keys, *[(F.col(f"all_{name}") - F.col(f"first.{name}")).alias(name) for name in parts])


def outcome_in_window(visits: DataFrame, threshold: float = REMISSION, clamp: bool = False) -> DataFrame:
    """Courses with a scored visit in the window, and whether any of them was in remission."""
    counted = course_outcomes(visits, threshold, clamp=clamp).where("late > 0")
    return counted.select(
        *COURSE,
        F.lit(1).cast("bigint").alias("has_followup"),
        (F.col("late_remission") > 0).cast("bigint").alias("has_remission_cdai"),
    )


def remission_groups(visits: DataFrame, threshold: float = REMISSION) -> DataFrame:
    """Early / late remission label for each course with a scored visit in either window."""
    counted = course_outcomes(visits, threshold).where("early > 0 OR late > 0")
    early, late = F.col("early_remission") > 0, F.col("late_remission") > 0
    label = (
        F.when(early & ~late, "Early only").when(~early & late, "Late only").when(early & late, "Early + Late")
    ).otherwise("Never")
    return counted.select(
        *COURSE,
        early.cast("bigint").alias("early_remission"),
        late.cast("bigint").alias("late_remission"),
        label.alias("remission_group"),
    )


def attach_outcome(
    baseline: DataFrame, outcome: DataFrame, name: str = "CDAI24_10", null_keys: bool = True
) -> DataFrame:
    """Baseline rows of courses that have an outcome.

    A missing key matches a missing key; say ``null_keys=False`` where keys are never missing,
    so the join can reuse the outcome's partitioning.
    """
    flags = outcome.select(*COURSE, F.col("has_remission_cdai").alias(name))
    return join_null_safe(baseline, flags, COURSE) if null_keys else baseline.join(flags, list(COURSE))
