"""Exact quantiles of many columns by radix selection on the bits of doubles.

The bits of a double, with all but the sign turned over for negative ones, order like the numbers as
whole numbers.  A pass counts the next 16 bits of the values whose bits so far are those of a wanted
quantile; after four passes the values are known, however many distinct ones there are.  One more pass
finds the next larger value of each.  Tasks send counts of cells, never values, and the driver gets
one row per column and quantile.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import col
from .ship import received, shipped

RADIX = 16
# Distinct cells a task holds before it sends them.
MOST_CELLS = 1 << 20
CELLS = "feature int, few boolean, cell bigint, n bigint"


def order_bits(values: np.ndarray) -> np.ndarray:
    """Whole numbers that order like the values; both zeros are one."""
    bits = (np.ascontiguousarray(values, np.float64) + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def from_order_bits(bits: np.ndarray) -> np.ndarray:
    bits = np.asarray(bits, np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)


def known_bits(batches: Iterator[pa.RecordBatch], features: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """The order bits of each feature's known values, batch by batch."""
    for batch in batches:
        for f in features:
            values = batch.column(f"x{f}").to_numpy(zero_copy_only=False).astype(np.float64)
            yield f, order_bits(values[~np.isnan(values)])


class Tally:
    """Counts per cell of some features, sent whenever they fill up."""

    def __init__(self):
        self.cells: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}

    def add(self, f: int, cells: np.ndarray) -> bool:
        """Whether it is time to send."""
        new, n = np.unique(cells, return_counts=True)
        if f in self.cells:
            both, at = np.unique(np.concatenate((self.cells[f], new)), return_inverse=True)
            n = np.bincount(at, np.concatenate((self.counts[f], n)), len(both)).astype(np.int64)
            new = both
        self.cells[f], self.counts[f] = new, n
        return sum(map(len, self.cells.values())) > MOST_CELLS

    def send(self, few: bool = False) -> Iterator[pa.RecordBatch]:
        for f, cells in self.cells.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cells), f, np.int32)), pa.array(np.full(len(cells), few)), pa.array(cells), pa.array(self.counts[f])],
                names=["feature", "few", "cell", "n"],
            )
        self.cells, self.counts = {}, {}


def _placed(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells with the running count of the feature's rows."""
    upto = Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    return cells.withColumn("upto", F.sum("n").over(upto) + F.col("before"))


def _completes(shares: int) -> Column:
    """Whether the running count completes a share of the feature's rows in a cell."""
    return F.expr(f"upto * {shares} div total > (upto - n) * {shares} div total")


def cuts_between(df: DataFrame, features: Sequence[str], shares: int) -> dict[str, list[tuple[float, float]]]:
    """Per feature the pairs of neighbouring values that a cut stands between, ascending.

    A feature of at most ``shares`` distinct values has a cut between all of them, any other one after each
    value at which a multiple of 1 / ``shares`` of its rows is complete.  Missing values take no part.
    """
    spark = df.sparkSession
    every = list(range(len(features)))
    source = df.select(*[col(name).cast("double").alias(f"x{f}") for f, name in enumerate(features)])

    def first(batches):
        tally, seen = Tally(), {f: np.zeros(0, np.int64) for f in every}
        for f, bits in known_bits(batches, every):
            if len(seen[f]) <= shares:
                # One more than wanted tells that there are too many.
                seen[f] = np.unique(np.concatenate((seen[f], bits)))[: shares + 1]
            if tally.add(f, bits >> (64 - RADIX)):
                yield from tally.send()
        yield from tally.send()
        for f, values in seen.items():
            tally.add(f, values)
        yield from tally.send(few=True)

    counted = source.mapInArrow(first, CELLS).groupBy("few", "feature", "cell").agg(F.sum("n").alias("n"))
    # A column has at most 2^16 cells, and of its distinct values one more than wanted is enough.  Both kinds come
    # from one pass over the rows.
    keys = ["few", "feature"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("cell"))
    cells = counted.withColumn("total", F.sum("n").over(Window.partitionBy(*keys))).withColumn("before", F.lit(0).cast("bigint"))
    rows = _placed(cells, keys).withColumn("nth", nth).where(F.when(F.col("few"), F.col("nth") <= shares + 1).otherwise(_completes(shares))).collect()

    few: dict[int, list[int]] = {f: [] for f in every}
    for r in rows:
        if r["few"]:
            few[r["feature"]].append(r["cell"])
    pairs: dict[int, list[tuple[int, int]]] = {f: list(zip(sorted(few[f]), sorted(few[f])[1:])) for f in every}
    many = [f for f in every if len(few[f]) > shares]
    if many:
        found = [(r["feature"], r["cell"], r["upto"] - r["n"], r["total"]) for r in rows if not r["few"] and r["feature"] in many]
        for taken in range(2 * RADIX, 65, RADIX):
            found = _refined(spark, source, many, found, shares, taken)
        chosen = {f: np.array(sorted(c for g, c, _, _ in found if g == f), np.int64) for f in many}
        above = _next_values(spark, source, many, chosen)
        for f in many:
            pairs[f] = [(int(x), above[f, i]) for i, x in enumerate(chosen[f]) if (f, i) in above]
    return {
        name: [(float(a), float(b)) for a, b in from_order_bits(np.array(pairs[f], np.int64).reshape(-1, 2)).tolist()] for f, name in enumerate(features)
    }


def _refined(spark, source: DataFrame, many: list[int], found: list[tuple], shares: int, taken: int) -> list[tuple]:
    """The wanted cells of ``taken`` bits inside those of ``RADIX`` bits less."""
    shared = shipped(spark, {f: np.array(sorted(c for g, c, _, _ in found if g == f), np.int64) for f in many})

    def count(batches):
        cells, tally = received(shared), Tally()
        for f, bits in known_bits(batches, many):
            cell = bits >> (64 - taken)
            at = np.searchsorted(cells[f], cell >> RADIX)
            inside = cells[f][np.minimum(at, len(cells[f]) - 1)] == cell >> RADIX
            if tally.add(f, cell[inside]):
                yield from tally.send()
        yield from tally.send()

    counted = source.mapInArrow(count, CELLS).groupBy("feature", "cell").agg(F.sum("n").alias("n"))
    # At most one row per column and share.
    parents = F.broadcast(spark.createDataFrame(found, "feature int, parent bigint, before bigint, total bigint"))
    placed = counted.withColumn("parent", F.shiftright("cell", RADIX)).join(parents, ["feature", "parent"])
    rows = _placed(placed, ["feature", "parent"]).where(_completes(shares)).collect()
    return [(r["feature"], r["cell"], r["upto"] - r["n"], r["total"]) for r in rows]


def _next_values(spark, source: DataFrame, many: list[int], chosen: dict[int, np.ndarray]) -> dict[tuple[int, int], int]:
    """(feature, number of a chosen value) -> the smallest value above it, where there is one."""
    shared = shipped(spark, chosen)
    none = np.iinfo(np.int64).max

    def least(batches):
        values = received(shared)
        best = {f: np.full(len(v) + 1, none) for f, v in values.items()}
        for f, bits in known_bits(batches, many):
            np.minimum.at(best[f], np.searchsorted(values[f], bits, side="left"), bits)
        for f, b in best.items():
            at = np.flatnonzero(b < none)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), pa.array(at.astype(np.int32)), pa.array(b[at])], names=["feature", "at", "least"])

    rows = source.mapInArrow(least, "feature int, at int, least bigint").groupBy("feature", "at").agg(F.min("least").alias("least")).collect()
    found = {(r["feature"], r["at"]): r["least"] for r in rows}
    out: dict[tuple[int, int], int] = {}
    for f in many:
        smallest = None
        # Between two chosen values may stand none but the second itself.
        for at in range(len(chosen[f]), 0, -1):
            here = found.get((f, at))
            smallest = here if smallest is None or (here is not None and here < smallest) else smallest
            if smallest is not None:
                out[f, at - 1] = smallest
    return out
