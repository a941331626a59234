"""Checks that ride on the pass that writes a table, instead of jobs of their own."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.nulls import col
from ..session import cut_lineage


@dataclass
class Watched:
    """A table written once, and what was seen of it on the way."""

    table: DataFrame
    seen: dict = field(default_factory=dict)


def row_facts(keys: Sequence[str]) -> dict[str, Column]:
    """How many rows there are, and a sum over the hashes of their keys: equal for equal sets of rows in any order."""
    return {"n_rows": F.count(F.lit(1)), "digest": F.sum(F.xxhash64(*[col(k) for k in keys]).cast("decimal(20,0)"))}


def watch(df: DataFrame, facts: dict[str, Column], write: Callable[[DataFrame], DataFrame] = cut_lineage) -> Watched:
    """``df`` as ``write`` stores it, with the aggregates ``facts`` of the same pass."""
    seen = Observation()
    table = write(df.observe(seen, *[fact.alias(name) for name, fact in facts.items()]))
    return Watched(table, seen.get)


def same_rows(one: Watched, other: Watched) -> None:
    """Both tables must be about the same rows, judged by what was seen when they were written."""
    for name in ("n_rows", "digest"):
        if one.seen[name] != other.seen[name]:
            raise ValueError(f"rows do not match: {one.seen} and {other.seen}")


def key_repeats(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key values that several rows share, missing ones included, with their number of rows."""
    return df.groupBy(*[col(k) for k in keys]).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
