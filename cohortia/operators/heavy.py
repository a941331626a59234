"""Frequent values of many columns by mergeable summaries.

Each task keeps a bounded number of counters per column.  When there are more values than counters, the
largest count that has to go is taken from all of them, so no value loses more than its task's rows divided by
the counters, and sums of summaries lose no more than all rows divided by the counters.  What the
summaries name is then counted exactly.  Shuffle and driver get a bounded number of rows per column.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import FLOATING, col, nan_as_null

COUNTERS = 256
COUNTED = "variable int, value string, n bigint"


@dataclass(frozen=True)
class Leaders:
    """What is known of a column: rows, known values, exact counts of its leaders, and how often any other value may occur."""

    rows: int
    known: int
    counts: tuple[int, ...]
    bound: int

    @property
    def others(self) -> int:
        """Rows with values that are no leaders."""
        return self.known - sum(self.counts)


def _as_text(df: DataFrame, name: str) -> Column:
    """A value as text, equal for equal values: one zero, and no NaN."""
    if isinstance(df.schema[name].dataType, FLOATING):
        return (nan_as_null(col(name)) + F.lit(0.0)).cast("string")
    return col(name).cast("string")


def shrunk(values: np.ndarray, counts: np.ndarray, counters: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``counters`` of the values, all counts less the largest that goes."""
    if len(values) <= counters:
        return values, counts
    counts = counts - np.partition(counts, -(counters + 1))[-(counters + 1)]
    return values[counts > 0], counts[counts > 0]


def _batches(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, pa.StructArray]]:
    for batch in batches:
        for i in range(n):
            yield i, pc.value_counts(batch.column(i).drop_null())


def _rows(i: int, values, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i] * len(values), pa.int32()), pa.array(values, pa.string()), pa.array(counts, pa.int64())], names=["variable", "value", "n"])


def leading_values(df: DataFrame, columns: Sequence[str], counters: int = COUNTERS) -> dict[str, Leaders]:
    """The leaders of each column; missing values and NaN are rows without a value."""
    columns = list(columns)
    if not columns:
        return {}
    texts = df.select(*[_as_text(df, name).alias(f"c{i}") for i, name in enumerate(columns)])
    n = len(columns)

    def summarise(batches):
        held = {i: (np.zeros(0, object), np.zeros(0, np.int64)) for i in range(n)}
        for i, found in _batches(batches, n):
            values, counts = held[i]
            both = pa.table(
                [
                    pa.concat_arrays([pa.array(values, pa.string()), found.field("values").cast(pa.string())]),
                    pa.concat_arrays([pa.array(counts, pa.int64()), found.field("counts").cast(pa.int64())]),
                ],
                names=["value", "n"],
            ).group_by("value").aggregate([("n", "sum")])
            held[i] = shrunk(both["value"].to_numpy(), both["n_sum"].to_numpy(), counters)
        for i, (values, counts) in held.items():
            yield _rows(i, values, counts)

    merged = texts.mapInArrow(summarise, COUNTED).groupBy("variable", "value").agg(F.sum("n").alias("n"))
    # A group limit: each task sends its largest only.
    nth = F.row_number().over(Window.partitionBy("variable").orderBy(F.desc("n"), "value"))
    named: dict[int, list[str]] = {i: [] for i in range(n)}
    for row in merged.withColumn("nth", nth).where(F.col("nth") <= counters).collect():
        named[row["variable"]].append(row["value"])

    def count(batches):
        wanted = {i: pa.array(v, pa.string()) for i, v in named.items()}
        sums = {i: np.zeros(len(v) + 1, np.int64) for i, v in named.items()}
        for i, found in _batches(batches, n):
            at = pc.fill_null(pc.index_in(found.field("values").cast(pa.string()), wanted[i]), len(named[i])).to_numpy()
            sums[i] += np.bincount(at, found.field("counts").to_numpy(), len(sums[i])).astype(np.int64)
        for i, s in sums.items():
            # The last is for all other values.
            yield _rows(i, [*named[i], None], s)

    exact = texts.mapInArrow(count, COUNTED).groupBy("variable", "value").agg(F.sum("n").alias("n")).collect()
    rows = texts.agg(F.count(F.lit(1))).first()[0]
    out = {}
    for i, name in enumerate(columns):
        counts = sorted((r["n"] for r in exact if r["variable"] == i and r["value"] is not None), reverse=True)
        known = sum(r["n"] for r in exact if r["variable"] == i)
        # A value above twice the loss is among the largest ``counters`` sums; without other values nothing is hidden.
        hidden = known - sum(counts)
        out[name] = Leaders(rows, known, tuple(counts), min(hidden, 2 * known // (counters + 1) + 1) if hidden else 0)
    return out


def near_zero(leaders: Leaders, freq_cut: float, unique_cut: float) -> bool | None:
    """Whether a column is near-constant; None where its leaders do not tell."""
    first, second = (*leaders.counts, 0, 0)[:2]
    if first == leaders.known:
        # One value at most.
        return True
    if second and first <= freq_cut * second and first >= leaders.bound:
        return False
    distinct_least, distinct_most = len(leaders.counts) + bool(leaders.others), len(leaders.counts) + leaders.others
    if 100.0 * distinct_least / leaders.rows > unique_cut:
        return False
    if first > freq_cut * max(second, leaders.bound) and 100.0 * distinct_most / leaders.rows <= unique_cut:
        return True
    return None
