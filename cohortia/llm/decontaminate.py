"""Finding benchmark passages in documents by q-gram filtering and banded alignment.

Every benchmark text is cut into overlapping probes.  If a document region is within ``k`` edits of a
probe of ``m`` characters, the two share at least m + 1 - q * (k + 1) q-grams, and these lie on
diagonals at most ``k`` apart.  Shared q-grams are counted in overlapping bands of diagonals; bands that
reach the bound are aligned, inside the band, with the probe.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets_for, col, free_name, stored, whole_text

# Characters of the benchmark whose probes are held at once: some 40 MB on the driver's way to the workers.
SHARD_CHARS = 500_000
MULTIPLIER = 0x9E3779B97F4A7C15
TABLE_BITS = 20
REGION = "array<struct<item_id:long,start:long,end:long,edits:int>>"


def normal(text: str) -> np.ndarray:
    """Code points of the text in lower case, white space runs as one blank."""
    return np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)


def grams(points: np.ndarray, q: int) -> np.ndarray:
    """A hash of every ``q`` neighbouring characters, ``q`` a power of two."""
    x, factor, n = points.astype(np.uint64), MULTIPLIER, 1
    while n < q:
        if len(x) <= n:
            return np.zeros(0, np.uint64)
        x = x[:-n] * np.uint64(factor) + x[n:]
        factor = factor * factor % 2**64
        n *= 2
    x = x ^ (x >> np.uint64(31))
    return x * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Probes:
    """The probes of a bounded share of the benchmark, with their q-gram index."""

    items: np.ndarray
    texts: list[np.ndarray]
    budgets: np.ndarray
    bounds: np.ndarray
    known: np.ndarray
    first: np.ndarray
    probe: np.ndarray
    offset: np.ndarray
    table: np.ndarray
    q: int
    band: int


def make_probes(items: list[tuple[int, str]], width: int, rate: float, q: int) -> Probes:
    ids, texts, budgets, bounds, keys, probe, offset = [], [], [], [], [], [], []
    seen = set()
    for item, text in items:
        points = normal(text)
        last = max(0, len(points) - width)
        # Each probe's budget reaches half a step to both sides, so every passage as long as a probe is near one.
        step = 2 * min(int(rate * width), max(0, (width - q) // q)) + 1
        for at in sorted({*range(0, last, step), last}):
            part = points[at : at + width]
            # The budget leaves at least one shared q-gram to count.
            budget = min(int(rate * len(part)), (len(part) - q) // q)
            if budget < 0 or (item, part.tobytes()) in seen:
                continue
            seen.add((item, part.tobytes()))
            k = grams(part, q)
            keys.append(k)
            probe.append(np.full(len(k), len(ids), np.int32))
            offset.append(np.arange(len(k), dtype=np.int32))
            ids.append(item)
            texts.append(part)
            budgets.append(budget)
            bounds.append(len(part) + 1 - q * (budget + 1))
    key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    known, first = np.unique(key[order], return_index=True)
    table = np.zeros(1 << TABLE_BITS, bool)
    table[known >> np.uint64(64 - TABLE_BITS)] = True
    join = lambda parts: np.concatenate(parts)[order] if parts else np.zeros(0, np.int32)
    band = 2 * max(budgets, default=0) + 1
    return Probes(
        np.array(ids, np.int64), texts, np.array(budgets, np.int64), np.array(bounds, np.int64), known,
        np.append(first, len(key)), join(probe), join(offset), table, q, band,
    )


def aligned(probe: np.ndarray, points: np.ndarray, low: int, high: int, budget: int | None = None):
    """(edits, start, end) of the best alignment of the probe to a stretch on diagonals ``low`` to ``high``.

    Cell d of row j is the cost of j probe characters ending at document position low + d + j.  Beyond
    the text stands a character that nothing equals: there a probe character costs one either way.
    Above ``budget`` edits the place is not looked for, and start and end are -1.
    """
    size = high - low + 1
    diagonal = np.arange(size, dtype=np.int32)
    first, last = max(low, 0), min(high + len(probe), len(points))
    window = np.full(size + len(probe), 2**32 - 1, np.uint32)
    if first < last:
        window[first - low : last - low] = points[first:last]
    differs = [window[j : j + size] != char for j, char in enumerate(probe)]
    cost = np.zeros(size, np.int32)
    rows = [cost]
    for differ in differs:
        best = cost + differ
        # A probe character left out: one diagonal further, at the same document position.
        np.minimum(best[:-1], cost[1:] + 1, out=best[:-1])
        # Document characters put in: along the row, by a running minimum.
        best -= diagonal
        np.minimum.accumulate(best, out=best)
        best += diagonal
        cost = best
        rows.append(cost)
    d = int(np.argmin(cost))
    edits, end = int(cost[d]), low + d + len(probe)
    if budget is not None and edits > budget:
        return edits, -1, -1
    # Back through the rows to where the stretch began.
    j = len(probe)
    while j:
        if d and rows[j][d] == rows[j][d - 1] + 1 and rows[j][d] != rows[j - 1][d] + differs[j - 1][d]:
            d -= 1
        elif rows[j][d] == rows[j - 1][d] + differs[j - 1][d]:
            j -= 1
        else:
            j, d = j - 1, d + 1
    start = low + d
    return edits, min(max(start, 0), len(points)), min(max(end, 0), len(points))


def regions(text: str, probes: Probes) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the probes found in one text, in normalised positions."""
    points = normal(text)
    hashes = grams(points, probes.q)
    place = np.flatnonzero(probes.table[hashes >> np.uint64(64 - TABLE_BITS)])
    if not len(place):
        return []
    slot = np.searchsorted(probes.known, hashes[place])
    slot[slot == len(probes.known)] = 0
    hit = probes.known[slot] == hashes[place]
    place, slot = place[hit], slot[hit]
    count = probes.first[slot + 1] - probes.first[slot]
    total = int(count.sum())
    if total < int(probes.bounds.min()):
        return []
    entry = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + np.repeat(probes.first[slot], count)
    which = probes.probe[entry].astype(np.int64)
    diagonal = np.repeat(place, count) - probes.offset[entry]
    # Bands are two steps wide and start at every step, so neighbouring diagonals share one.
    step = probes.band
    bands = (len(points) + 2 * 4096) // step + 4
    band = (diagonal + 4096) // step + 1
    both = np.concatenate((which * bands + band, which * bands + band - 1))
    key, n = np.unique(both, return_counts=True)
    key = key[n >= probes.bounds[key // bands]]
    if not len(key):
        return []
    # In what is left each probe position counts once, however often its q-gram stands in the band.
    use = np.isin(both, key)
    offset = np.tile(probes.offset[entry], 2)[use].astype(np.int64)
    key, n = np.unique(np.unique(both[use] * 4096 + offset) // 4096, return_counts=True)
    key = key[n >= probes.bounds[key // bands]]
    found, before = {}, {}
    for p, b in zip((key // bands).tolist(), (key % bands).tolist()):
        budget, probe = int(probes.budgets[p]), probes.texts[p]
        low = (b - 1) * step - 4096 - budget
        high = low + 2 * step + 2 * budget
        if low <= before.get(p, low - 1) <= high:
            # The band before this one has the same stretch.
            continue
        edits, start, end = aligned(probe, points, low, high, budget)
        if edits <= budget:
            before[p] = start
            spot = (int(probes.items[p]), start, end)
            found[spot] = min(edits, found.get(spot, edits))
    return sorted((*spot, edits) for spot, edits in found.items())


def find_regions(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 64,
    rate: float = 0.1,
    q: int = 8,
    column: str = "regions",
) -> DataFrame:
    """``docs`` with ``column``: the regions that a benchmark probe matches, as (item, start, end, edits).

    Texts are compared in lower case with white space runs as one blank; positions are in that form.  A
    probe is ``width`` characters of an item, or the whole of a shorter item; it matches within ``rate``
    times its length in edits.  Probes start so close that every verbatim passage of ``width`` characters
    is found, and every one a step longer within the edits of a probe.  Items under ``q`` characters and items without
    an id or text are left out; missing and empty texts have no regions; repeated rows are judged each.
    The benchmark is sent in shares of about ``SHARD_CHARS`` characters, one pass over the texts each.  A share
    leaves the driver and the workers before the next one comes, so memory does not grow with the benchmark;
    with several shares the regions found are written and joined to the rows by a hash of the text.
    """
    items = benchmark.where(col(item_col).isNotNull() & col(item_text_col).isNotNull()).select(
        col(item_col).cast("long").alias("item"), col(item_text_col).alias("text")
    )
    size = items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    shares = buckets_for(size, SHARD_CHARS)
    if column in docs.columns:
        raise ValueError(f"the table has a column {column} already")
    text_at = docs.columns.index(text_col)
    share_of = F.pmod(F.xxhash64("item", "text"), F.lit(shares))

    def sent(share: int):
        part = sorted((r["item"], r["text"]) for r in items.where(share_of == share).collect())
        return docs.sparkSession.sparkContext.broadcast(vars(make_probes(part, width, rate, q)))

    def found(text: str | None, probes: Probes) -> list[dict]:
        return [dict(zip(("item_id", "start", "end", "edits"), r)) for r in regions(text or "", probes)] if probes.texts else []

    region_type = pa.list_(pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))
    if shares == 1:
        only = sent(0)

        def add(batches):
            probes = Probes(**only.value)
            for b in batches:
                rows = [found(t, probes) for t in b.column(text_at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, region_type)], names=[*b.schema.names, column])

        return docs.mapInArrow(add, docs.withColumn(column, F.array().cast(REGION)).schema)

    key = free_name(docs, "key")
    texts = docs.select(F.sha2(whole_text(text_col), 256).alias("key"), whole_text(text_col).alias("text"))
    parts = []
    for share in range(shares):
        here = sent(share)

        def hits(batches, here=here):
            probes = Probes(**here.value)
            for b in batches:
                rows = [(k, r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if (r := found(t, probes))]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([r for _, r in rows], region_type)], names=["key", "found"])

        # Copies of a text have the same regions.
        parts.append(stored(texts.mapInArrow(hits, f"key string, found {REGION}").groupBy("key").agg(F.first("found").alias("found")), "regions"))
        here.destroy()
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    every = every.groupBy(F.col("key").alias(key)).agg(F.array_sort(F.flatten(F.collect_list("found"))).alias(column))
    joined = docs.withColumn(key, F.sha2(whole_text(text_col), 256)).hint("merge").join(every, key, "left")
    return joined.select(*[col(c).alias(c) for c in docs.columns], F.coalesce(col(column), F.array().cast(REGION)).alias(column))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The id, ``contaminated``, the ``item_ids`` found, ``n_regions`` and ``fewest_edits`` of every row."""
    given = docs.select(col(id_col).alias("id"), whole_text(text_col).alias("text"))
    found = find_regions(given, benchmark, text_col="text", **settings)
    return found.select(
        F.col("id").alias(id_col),
        (F.size("regions") > 0).alias("contaminated"),
        F.array_sort(F.array_distinct(F.col("regions.item_id"))).alias("item_ids"),
        F.size("regions").cast("long").alias("n_regions"),
        F.array_min(F.col("regions.edits")).alias("fewest_edits"),
    )
