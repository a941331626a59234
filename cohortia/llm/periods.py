"""Runs of periodic words, found in overlapping tiles per octave of periods and stitched together.

An octave holds the periods from 2^k up to twice that; the lowest one all below 8.  A run of three
periods of an octave has, at one multiple of its spacing, a block of one spacing that comes again one
period later and goes on to match for more than a whole period.  Block names, made by doubling, tell
these boundaries for all positions at once.

1. Each text is exploded, octave by octave, into tiles of several spacings that overlap by more than
   two periods; tiles without such a boundary hold no part of a run and are not sent.
2. A tile is solved by itself, wherever it lands: Z-functions forward and backward from a boundary
   give the extent of every period there, cut at the tile's ends.
3. Fragments are shuffled by document and period.  Two of them belong to the same run if they overlap
   by a period or more; running maxima stitch them.
4. The runs of a document meet its text again, which is collapsed to their first periods.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import col, free_name, process_cache, stored, whole_text
from .repeats import WordHashes, mix

GAP = re.compile(rb"[\x20\x09-\x0d]")
# Periods below the lowest spacing share one octave.
LOWEST = 3
LEAST_LENGTH, LEAST_PERIODS = 24, 3
# A tile spans so many words or spacings, whichever is more.
TILE_WORDS, TILE_SPACINGS = 4096, 4
PIECE = 1 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
FRAGMENT = "key binary, period long, start long, stop long"


def planted_tail(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): the words from ``a`` on repeat the ``p`` first of them; for one id in ten, none without an id or words."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def text_pieces(data: bytes) -> Iterator[bytes]:
    """``data`` cut between words, in pieces of about ``PIECE`` bytes."""
    at = 0
    while at < len(data):
        gap = GAP.search(data, at + PIECE)
        end = len(data) if gap is None else gap.start()
        yield data[at:end]
        at = end


def word_codes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word."""
    known = process_cache("word hashes", WordHashes)
    parts = []
    for piece in text_pieces(data):
        words = piece.split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)))
    return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def original(n: int, tail: tuple[int, int] | None) -> np.ndarray:
    """Which word of the text stands at each place once the tail repeats."""
    place = np.arange(n)
    if tail is not None:
        a, p = tail
        place[a:] = a + (place[a:] - a) % p
    return place


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    signs = np.frombuffer(data, np.uint8)
    gap = np.ones(len(signs) + 2, np.int8)
    gap[1:-1] = (signs == 32) | ((signs >= 9) & (signs <= 13))
    edge = np.diff(gap)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


def joined(data: bytes, places: np.ndarray) -> bytes:
    """The words at ``places`` of the text, joined by one space."""
    starts, ends = word_spans(data)
    out = []
    for at in range(0, len(places), 65_536):
        part = places[at : at + 65_536]
        out.append(b" ".join([data[s:e] for s, e in zip(starts[part].tolist(), ends[part].tolist())]))
    return b" ".join(out)


def spacing(octave: int) -> int:
    return 1 << max(octave, LOWEST)


def octaves(n: int) -> list[int]:
    """The octaves that a text of ``n`` words can have runs in; ``LOWEST`` - 1 stands for all periods below 2^LOWEST."""
    if n < LEAST_LENGTH:
        return []
    top = (n // LEAST_PERIODS).bit_length() - 1
    return [LOWEST - 1, *range(LOWEST, top + 1)]


def doubled(names: np.ndarray, width: int) -> np.ndarray:
    """Names of blocks twice as long as ``width``."""
    if len(names) <= width:
        return names[:0]
    return mix(names[:-width] * MULTIPLIER + names[width:])


def block_names(codes: np.ndarray, width: int) -> np.ndarray:
    names, n = codes.astype(np.uint64), 1
    while n < width:
        names, n = doubled(names, n), 2 * n
    return names


def candidates(names: np.ndarray, octave: int, offset: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries and periods of ``octave`` whose match goes on for long enough, sorted.

    ``names`` are those of blocks of one spacing, ``offset`` what to add to a place to get a multiple of
    the spacing where boundaries stand.
    """
    step = spacing(octave)
    at = np.arange(-offset % step, len(names), step)
    if octave < LOWEST:
        found = []
        for p in range(1, step):
            c = at[at + p < len(names)]
            c = c[names[c] == names[c + p]]
            found.append(np.column_stack((c, np.full(len(c), p))))
        c, p = np.concatenate(found).T
    else:
        if not len(at) or at[0] + step >= len(names):
            return at[:0], at[:0]
        after = names[at[0] + step :]
        before = np.repeat(names[at], step)[: len(after)]
        place = np.flatnonzero(after == before[: len(after)])
        c = at[place // step]
        p = place + at[0] + step - c
        # The block that ends a word after the first period matches too, so the whole match is longer than the period.
        last = c + p + 1 - step
        use = last + p < len(names)
        c, p, last = c[use], p[use], last[use]
        use = names[last] == names[last + p]
        c, p = c[use], p[use]
    order = np.lexsort((p, c))
    return c[order], p[order]


def tiles(codes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
    """(octave, first, last, left, right): boundaries from ``first`` to before ``last`` are solved in words ``left`` to ``right``."""
    n = len(codes)
    width = spacing(LOWEST)
    names = block_names(codes, width)
    # A run brings its first block again one period later; most texts bring none again.
    ordered = np.sort(names)
    if not (ordered[1:] == ordered[:-1]).any():
        return
    for octave in octaves(n):
        step = spacing(octave)
        while width < step:
            names, width = doubled(names, width), 2 * width
        found, _ = candidates(names, octave)
        if len(found):
            size = max(TILE_WORDS, TILE_SPACINGS * step)
            for t in np.unique(found // size).tolist():
                yield octave, t * size, (t + 1) * size, max(0, t * size - step), min(n, (t + 1) * size + 4 * step)


def z_function(s: list) -> list[int]:
    """How far the sequence matches itself from each place on; 0 at its start."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z


def solve(codes: np.ndarray, octave: int, first: int, last: int, left: int) -> list[tuple[int, int, int]]:
    """(period, start, stop) of the primitive periods of ``octave`` at the tile's boundaries, cut at its ends.

    ``codes`` are the tile's words, the first of them word ``left`` of the text.
    """
    step = spacing(octave)
    most = step if octave < LOWEST else 2 * step
    boundary, period = candidates(block_names(codes, step), octave, left)
    inside = (boundary + left >= first) & (boundary + left < last)
    boundary, period = boundary[inside], period[inside]
    words = codes.tolist()
    # Stretches whose period is known: (start, stop, period).
    known: list[tuple[int, int, int]] = []
    found = []
    for c, lo, hi in zip(*(x.tolist() for x in groups_of(boundary))):
        p = period[lo:hi]
        for s, e, q in known:
            if s <= c < e:
                # Where q repeats already, a multiple of q is q itself or no primitive period.
                p = p[(p % q != 0) | (c + p + step > e)]
        if not len(p):
            continue
        forward = np.array(z_function(words[c:]), np.int64)
        before = words[:c][::-1]
        ahead = words[: c + most][::-1][:-c] if c else words[:most][::-1]
        # The words before the boundary, backwards, against those that end 1 to ``most`` words later.
        z = z_function([*before, -1, *ahead, *before])
        back = lambda q: z[len(before) + 1 + len(ahead) - q]  # noqa: B023, E731
        q = np.arange(1, min(step, len(forward)))
        own = q[q + forward[q] >= step]
        least = int(own[0]) if len(own) else 0
        power = np.zeros(len(p), bool)
        if least:
            power |= (p % least == 0) & (least < p) & (forward[least] >= p - least)
            known.append((c - back(least), c + least + int(forward[least]), least))
        for r in (2, 3):
            power |= (p % r == 0) & (forward[p // r] >= p - p // r)
        for one in p[~power].tolist():
            start, stop = c - back(one), c + one + int(forward[one])
            known.append((start, stop, one))
            found.append((one, start + left, stop + left))
    return found


def groups_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, and where each begins and ends."""
    value, start = np.unique(values, return_index=True)
    return value, start, np.append(start[1:], len(values))


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of ``n`` words some run (start, length, period) contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) > 0


def periodic_runs(
    docs: DataFrame, tail: Callable[[int | None, int], tuple[int, int] | None] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id, ``n_words``, ``runs`` (array of start, length, period; by start, then period) and ``kept`` of every row.

    Words stand between ASCII white space.  A run is a stretch of at least 24 words and three times its
    smallest period that no neighbouring word extends.  ``kept`` are the words that no run contains after
    its first period, joined by one space, as bytes.  ``tail`` may say, by id and number of words, from
    where on and with which period a text's words are to repeat before they are searched.

    A missing, empty or blank text has no words, no runs and an empty ``kept``.  Rows are judged one by
    one: repeated rows get the same result each, and an id may be missing.  Other columns are ignored; an
    empty table gives no rows.
    """
    given = docs.select(col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))

    def read(vertex, text):
        data = text.encode("utf-8", "surrogatepass")
        codes = word_codes(data)
        place = tail(vertex, len(codes)) if tail else None
        if place is not None:
            place = original(len(codes), place)
            codes = codes[place]
        return data, codes, place

    def explode(batches):
        """The tiles of texts that have some, and one row with the text itself."""
        fields = ["key", "id", "text", "octave", "first", "last", "left", "codes"]
        kinds = [pa.binary(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        pack = zstandard.ZstdCompressor(level=1)
        for b in batches:
            out, size = [], 0
            for vertex, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, codes, _ = read(vertex, text)
                key = None
                for octave, first, last, left, right in tiles(codes):
                    if key is None:
                        key = xxhash.xxh3_128_digest(data + b"\n" + str(vertex).encode())
                        small = np.unique(codes, return_inverse=True)[1].astype(np.int32)
                        out.append((key, vertex, text, None, None, None, None, None))
                        size += len(data)
                    part = pack.compress(small[left:right].tobytes())
                    out.append((key, None, None, octave, first, last, left, part))
                    size += len(part)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=fields)
                        out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=fields)

    exploded = stored(
        given.mapInArrow(explode, "key binary, id long, text string, octave int, first long, last long, left long, codes binary"), "tiles"
    )
    # Rows that share id and text bring the same tiles, which are solved once.
    place = ["key", "octave", "first"]
    tile = exploded.where(F.col("octave").isNotNull()).select("key", "octave", "first", "last", "left", "codes")
    tile = tile.groupBy(*place).agg(*[F.first(c).alias(c) for c in ("last", "left", "codes")])

    def solved(batches):
        unpack = zstandard.ZstdDecompressor()
        for b in batches:
            out = []
            for key, octave, first, last, left, codes in zip(*(c.to_pylist() for c in b.columns)):
                words = np.frombuffer(unpack.decompress(codes), np.int32)
                out += [(key, *f) for f in solve(words, octave, first, last, left)]
            if out:
                kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["key", "period", "start", "stop"])

    fragments = tile.mapInArrow(solved, FRAGMENT)
    by_start = Window.partitionBy("key", "period").orderBy("start", "stop")
    so_far = F.max("stop").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    breaks = F.coalesce(F.col("start") + F.col("period") > so_far, F.lit(True)).cast("long")
    pieces = fragments.withColumn("break", breaks).withColumn("run", F.sum("break").over(by_start))
    whole = pieces.groupBy("key", "period", "run").agg(F.min("start").alias("start"), (F.max("stop") - F.min("start")).alias("length"))
    whole = whole.where((F.col("length") >= LEAST_LENGTH) & (F.col("length") >= LEAST_PERIODS * F.col("period")))
    whole = whole.groupBy("key", "start", "length").agg(F.min("period").alias("period"))
    runs = whole.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("found"))

    schema = "id long, n_words long, runs array<struct<start: long, length: long, period: long>>, kept binary"
    names = ["id", "n_words", "runs", "kept"]
    entry = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def collapse(batches):
        for b in batches:
            n_words, out = [], []
            found = b.column(2).to_pylist()
            for vertex, text, own in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), found):
                data, codes, place = read(vertex, text)
                gone = dropped([(r["start"], r["length"], r["period"]) for r in own or ()], len(codes))
                place = np.arange(len(codes)) if place is None else place
                n_words.append(len(codes))
                out.append(joined(data, place[~gone]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array([f or [] for f in found], entry), pa.array(out, pa.binary())], names=names
            )

    def untouched(batches):
        """The rows that ``explode`` found no tile in."""
        for b in batches:
            ids, n_words, out = [], [], []
            for vertex, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                data, codes, place = read(vertex, text)
                if next(tiles(codes), None) is not None:
                    continue
                ids.append(vertex)
                n_words.append(len(codes))
                out.append(b" ".join(filter(None, (b" ".join(p.split()) for p in text_pieces(data)))) if place is None else joined(data, place))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array([[]] * len(ids), entry), pa.array(out, pa.binary())], names=names
            )

    # Texts with tiles grow with the corpus, so neither side is broadcast.
    texts = exploded.where(F.col("octave").isNull()).select("key", "id", "text")
    some = texts.hint("merge").join(runs, "key", "left").select("id", "text", "found").mapInArrow(collapse, schema)
    return given.mapInArrow(untouched, schema).unionByName(some).withColumnRenamed("id", id_col)


def run_digests(found: DataFrame) -> DataFrame:
    """``found`` of ``periodic_runs`` with the number of runs, the one of the greatest exponent, and digests.

    The exponent is length / period, compared exactly; ties go to the smallest start, then period.
    """
    runs = F.col("runs")

    def better(best, run):
        """The run with the greater length / period; the earlier one, in order, on ties."""
        more = run["length"].cast("decimal(38,0)") * best["period"] > best["length"].cast("decimal(38,0)") * run["period"]
        return F.when(best.isNull() | more, run).otherwise(best)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    lines = F.transform(runs, lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = free_name(found, "best")
    out = found.withColumn(best, F.aggregate(runs, none, better))
    return out.select(
        *[col(c).alias(c) for c in found.columns if c not in ("runs", "kept", "n_words")],
        F.size(runs).cast("long").alias("n_runs"),
        *[F.col(best).getField(f).alias(f) for f in ("start", "length", "period")],
        F.expr(f"({best}.length * 1000) div {best}.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("kept", 256).alias("collapsed_sha256"),
    )
