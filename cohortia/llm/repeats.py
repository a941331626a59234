"""Finding windows of text that also start in an earlier document, for a whole corpus.

A window is a fixed number of consecutive units (bytes or words) of one document.  Each window has an
anchor: the least hash of the short grams inside it.  Equal windows have equal anchors, and about a
dozen neighbouring windows share one, so a run of them travels as one passage under its anchor.

1. Documents are dealt into blocks by hash.  Each block tells which anchors it has, and how often;
   the answer says which anchors two documents have at all, and which are hot.
2. Only passages under such anchors travel, to the shard of their anchor.  Windows under a hot anchor
   travel one by one, to the shard of their own content and once per block, so no shard grows with
   the number of copies of a passage.
3. A shard compares its passages by a matcher (suffix array or suffix automaton), and returns to each
   block the starts of its covered windows.  The block marks the units they cover.

Blocks are hash partitions of one exchange that all three steps read.  Anything a task emits is a
function of its block's rows in a fixed order, so recomputed tasks emit the same.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buckets_for, col, process_cache, whole_text

BLOCK_BYTES = 1_000_000
# A shard gets one row per block, so rows stay worth sending only up to so many shards.
MOST_SHARDS = 4096
# Anchors with more occurrences than this send single windows.
HOT = 8192
SLICE = 32_768
MOST_WORDS = 120_000
NO_ID = np.iinfo(np.int64).max
MULTIPLIER = 0x9E3779B97F4A7C15
# Two hashes together stand for the content of a window inside a block.
MULTIPLIERS = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(units: np.ndarray, width: int, multiplier: int = MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of every run of ``width`` units, by doubling."""
    x, factor, n = units.astype(np.uint64), multiplier, 1
    while 2 * n <= width:
        x = x[:-n] * np.uint64(factor) + x[n:]
        factor = factor * factor % 2**64
        n *= 2
    if n < width:
        rest = width - n
        x = x[:-rest] * np.uint64(pow(multiplier, 5, 2**64)) + x[rest:]
    return mix(x)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return x if n == width else np.minimum(x[: n - width], x[width - n :])


class Bytes:
    """Units are the bytes of the UTF-8 text."""

    gram = 16

    @staticmethod
    def read(texts: list[bytes]):
        """All units of the texts, how many each has, and what ``slice`` cuts."""
        joined = b"".join(texts)
        return np.frombuffer(joined, np.uint8), list(map(len, texts)), joined

    @staticmethod
    def parts(text: bytes) -> bytes:
        return text

    @staticmethod
    def slice(source: bytes, start: int, end: int) -> bytes:
        return source[start:end]


class WordHashes(dict):
    """Hashes of words, kept for the first ``MOST_WORDS`` distinct ones a worker meets."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < MOST_WORDS:
            self[word] = h
        return h


class Words:
    """Units are words between ASCII white space; ``bytes.split`` splits at exactly that."""

    gram = 4

    @staticmethod
    def read(texts: list[bytes]):
        lists = [t.split() for t in texts]
        words = [w for words in lists for w in words]
        known = process_cache("word hashes", WordHashes)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), list(map(len, lists)), words

    @staticmethod
    def parts(text: bytes) -> list[bytes]:
        return text.split()

    @staticmethod
    def slice(source: list[bytes], start: int, end: int) -> bytes:
        return b" ".join(source[start:end])


class Block:
    """The documents of a block in a fixed order, and their units in one row."""

    def __init__(self, rows: pa.Table):
        unpack = zstandard.ZstdDecompressor().decompress
        ids, texts = rows.column("id").to_pylist(), [unpack(t) for t in rows.column("packed").to_pylist()]
        order = sorted(range(len(ids)), key=lambda i: (NO_ID if ids[i] is None else ids[i], texts[i]))
        self.carried = rows.column("carried").take(pa.array(order, pa.int64())).combine_chunks()
        self.ids = [ids[i] for i in order]
        self.texts = [texts[i] for i in order]
        # A row without an id comes after all others.
        self.rank = np.array([NO_ID if i is None else i for i in self.ids], np.int64)

    def load(self, kind) -> None:
        self.units, counts, self.source = kind.read(self.texts)
        self.bounds = np.concatenate(([0], np.cumsum(np.array(counts, np.int64))))

    def runs(self, width: int, gram: int):
        """(document, start, windows, anchor) of every run of windows under one anchor."""
        n = len(self.units) - width + 1
        if n <= 0:
            none = np.zeros(0, np.int64)
            return none, none, none, none.astype(np.uint64)
        key = sliced(self.units, width, lambda part: sliding_min(window_hashes(part, gram), width - gram + 1))
        doc = np.repeat(np.arange(len(self.texts), dtype=np.int32), np.diff(self.bounds))[:n]
        whole = np.arange(n) + width <= self.bounds[1:][doc]
        changes = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (whole[1:] != whole[:-1])
        start = np.flatnonzero(np.concatenate(([True], changes)))
        count = np.diff(np.append(start, n))
        use = whole[start]
        start, count = start[use], count[use]
        # 48 bits tell anchors apart well enough: a rare collision only makes some passages travel in vain.
        # Mixed once more, since minima lie close to zero and shards are ranges of anchors.
        return doc[start].astype(np.int64), start, count, mix(key[start]) >> np.uint64(16) << np.uint64(16)


def sliced(units: np.ndarray, width: int, of) -> np.ndarray:
    """``of`` over all windows, in parts that fit the processor's cache."""
    n = len(units) - width + 1
    return np.concatenate([of(units[at : min(n, at + SLICE) + width - 1]) for at in range(0, n, SLICE)])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def planes(values: np.ndarray) -> bytes:
    """The bytes of 64-bit values, first bytes first: the planes of small values are all zero and shrink away."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(data, at: int, n: int, kind) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, 8 * n, at).reshape(8, n).T).view(kind).reshape(n)


def packed(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))


def pack_anchors(anchors: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending anchors as differences, and their counts."""
    return packed(planes(np.diff(anchors >> np.uint64(16), prepend=np.uint64(0))), counts.tobytes())


def unpack_anchors(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = unpacked(payload)
    n = len(data) // 9
    return np.cumsum(from_planes(data, 0, n, np.uint64)) << np.uint64(16), np.frombuffer(data, np.uint8, n, 8 * n)


def unpacked(payload: bytes) -> memoryview:
    return memoryview(zstandard.ZstdDecompressor().decompress(payload))


def covered_starts(
    docs: DataFrame, width: int, kind, match: Callable, finish: Callable, out: T.StructType, id_col: str, text_col: str, carry: list[str] | None = None
) -> DataFrame:
    """Run the three steps; ``finish(block, covered)`` makes the rows of a block.

    ``match(anchors, ranks, counts, data, ends)`` gets the passages of a shard, one after the other in
    ``data``, and gives, for each of their windows in order, whether it also starts in a document of
    lower rank.  ``covered(n)`` gives the sorted starts of the covered windows of the block's n-th row.
    """
    spark = docs.sparkSession
    # Carried columns stand in one struct, so their names cannot clash with others.
    carried = F.struct(*[col(c).alias(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    given = docs.select(col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"), carried.alias("carried"))
    size = given.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = buckets_for(size, BLOCK_BYTES)
    shards = min(buckets_for(blocks, 2), MOST_SHARDS)
    # Text is part of the hash, so rows that share an id, or have none, spread too.
    block = F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("int")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def press(batches):
        level = zstandard.ZstdCompressor(level=3)
        for b in batches:
            texts = [level.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()), b.column(2), b.column(3)], names=names)

    # The texts move once, compressed by themselves, and all three steps read that exchange.
    rows = given.withColumn("block", block)
    names = ["id", "packed", "carried", "block"]
    types = [rows.schema["id"], T.StructField("packed", T.BinaryType()), rows.schema["carried"], rows.schema["block"]]
    dealt = rows.mapInArrow(press, T.StructType(types)).repartition(parts, "block")
    route_type = "shard int, block int, local boolean, payload binary"
    answer_type = "block int, shard int, payload binary"

    def by_shard(target: np.ndarray):
        """(shard, slice) over rows sorted by shard."""
        cut = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1]))) if len(target) else []
        for a, b in zip(cut, np.append(cut[1:], len(target)).astype(int) if len(target) else []):
            yield int(target[a]), slice(int(a), int(b))

    def table_of(rows: list, names: list[str], types: list) -> pa.Table:
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

    route_names, route_kinds = ["shard", "block", "local", "payload"], [pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
    answer_names, answer_kinds = ["block", "shard", "payload"], [pa.int32(), pa.int32(), pa.binary()]

    def anchors_of(runs) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors of a block, ascending, and how many of its documents have them."""
        docs_at, _, _, anchors = runs
        order = np.lexsort((docs_at, anchors))
        key, doc = anchors[order], docs_at[order]
        first = np.ones(len(key), bool)
        first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        return np.unique(key[first], return_counts=True)

    def loaded(rows) -> Block:
        block_rows = Block(rows)
        block_rows.load(kind)
        return block_rows

    def tell(key, rows):
        anchors, counts = anchors_of(loaded(rows).runs(width, kind.gram))
        counts = np.minimum(counts, 255).astype(np.uint8)
        made = [(s, key[0].as_py(), False, pack_anchors(anchors[p], counts[p])) for s, p in by_shard(shard_of(anchors, shards))]
        return table_of(made, route_names, route_kinds)

    def judge(key, rows):
        """Two bits per anchor of each block: two documents have it; it is hot."""
        blocks_here, payloads = rows.column("block").to_pylist(), rows.column("payload").to_pylist()
        parts_here = [unpack_anchors(p) for p in payloads]
        sizes = [len(a) for a, _ in parts_here]
        anchors, counts = (np.concatenate([p[i] for p in parts_here]) for i in (0, 1))
        order = np.argsort(anchors, kind="stable")
        starts = np.flatnonzero(np.concatenate(([True], anchors[order][1:] != anchors[order][:-1])))
        total = np.add.reduceat(counts[order].astype(np.int64), starts)
        total = np.repeat(total, np.diff(np.append(starts, len(anchors))))
        sums = np.empty(len(anchors), np.int64)
        sums[order] = total
        out_rows, at = [], 0
        for b, n in zip(blocks_here, sizes):
            part = sums[at : at + n]
            out_rows.append((b, key[0].as_py(), np.packbits(part > 1).tobytes() + np.packbits(part > HOT).tobytes()))
            at += n
        return table_of(out_rows, answer_names, answer_kinds)

    def send(key, rows, answers):
        here, number = loaded(rows), key[0].as_py()
        runs = here.runs(width, kind.gram)
        anchors, _ = anchors_of(runs)
        shared, hot = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
        where = dict(by_shard(shard_of(anchors, shards)))
        for s, payload in zip(answers.column("shard").to_pylist(), answers.column("payload").to_pylist()):
            n = where[s].stop - where[s].start
            bits = np.frombuffer(payload, np.uint8)
            half = len(bits) // 2
            shared[where[s]] = np.unpackbits(bits[:half])[:n]
            hot[where[s]] = np.unpackbits(bits[half:])[:n]
        made = []
        doc, start, count, anchor = runs
        at = np.searchsorted(anchors, anchor)
        keep = shared[at] & ~hot[at]
        p_rank, p_start, p_count, p_anchor = here.rank[doc[keep]], start[keep], count[keep], anchor[keep]
        if hot.any():
            # Windows under hot anchors go one by one: the block's first document asks, later ones know.
            single = hot[at]
            window = ranges(start[single], count[single])
            rank = here.rank[np.repeat(doc[single], count[single])]
            one, two = (sliced(here.units, width, lambda part, m=m: window_hashes(part, width, m))[window] for m in MULTIPLIERS)
            order = np.lexsort((rank, two, one))
            fresh = np.ones(len(order), bool)
            fresh[1:] = (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
            least = rank[order][fresh][np.cumsum(fresh) - 1]
            later = np.empty(len(order), bool)
            later[order] = rank[order] > least
            if later.any():
                made.append((number % shards, number, True, packed(planes(np.sort(window[later])))))
            asks = ~later
            p_rank, p_start = np.concatenate((p_rank, rank[asks])), np.concatenate((p_start, window[asks]))
            p_count = np.concatenate((p_count, np.ones(int(asks.sum()), np.int64)))
            p_anchor = np.concatenate((p_anchor, one[asks]))
        target = shard_of(p_anchor, shards)
        order = np.argsort(target, kind="stable")
        for s, part in by_shard(target[order]):
            these = order[part]
            ends = p_start[these] + p_count[these] + (width - 1)
            texts = [kind.slice(here.source, a, b) for a, b in zip(p_start[these].tolist(), ends.tolist())]
            lengths = np.fromiter(map(len, texts), np.int64, len(texts))
            numbers = (p_anchor[these], p_rank[these], p_start[these], p_count[these], lengths)
            head = np.array([len(these)], np.int64).tobytes()
            made.append((s, number, False, packed(head, *map(planes, numbers), *texts)))
        return table_of(made, route_names, route_kinds)

    def compare(key, rows):
        out_rows, parts_here = [], []
        for b, local, payload in zip(*(rows.column(n).to_pylist() for n in ("block", "local", "payload"))):
            if local:
                out_rows.append((b, key[0].as_py(), payload))
                continue
            data = unpacked(payload)
            n = int(np.frombuffer(data, np.int64, 1)[0])
            kinds = (np.uint64, np.int64, np.int64, np.int64, np.int64)
            fields = [from_planes(data, 8 + 8 * n * i, n, t) for i, t in enumerate(kinds)]
            parts_here.append((b, fields, bytes(data[8 + 40 * n :])))
        if parts_here:
            anchors, ranks, starts, counts, lengths = (np.concatenate([p[1][i] for p in parts_here]) for i in range(5))
            flags = match(anchors, ranks, counts, b"".join(p[2] for p in parts_here), np.cumsum(lengths))
            owner = np.repeat(np.concatenate([np.full(len(p[1][0]), p[0], np.int32) for p in parts_here]), counts)[flags]
            window = ranges(starts, counts)[flags]
            order = np.argsort(owner, kind="stable")
            for b, part in by_shard(owner[order]):
                out_rows.append((b, key[0].as_py(), packed(planes(np.sort(window[order[part]])))))
        return table_of(out_rows, answer_names, answer_kinds)

    def close(key, rows, answers):
        here = loaded_bounds(rows)
        found = [np.zeros(0, np.int64)]
        for payload in answers.column("payload").to_pylist():
            data = unpacked(payload)
            found.append(from_planes(data, 0, len(data) // 8, np.int64))
        found = np.sort(np.concatenate(found))
        cut = np.searchsorted(found, here.bounds)

        def covered(n: int) -> np.ndarray:
            return found[cut[n] : cut[n + 1]] - here.bounds[n]

        return finish(here, covered)

    def loaded_bounds(rows) -> Block:
        """A block without unit hashes, only with the number of units of each row."""
        here = Block(rows)
        here.parts = [kind.parts(t) for t in here.texts]
        here.bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, here.parts), np.int64, len(here.parts)))))
        return here

    told = dealt.groupBy("block").applyInArrow(tell, route_type)
    judged = told.groupBy("shard").applyInArrow(judge, answer_type)
    sent = dealt.groupBy("block").cogroup(judged.groupBy("block")).applyInArrow(send, route_type)
    compared = sent.groupBy("shard").applyInArrow(compare, answer_type)
    return dealt.groupBy("block").cogroup(compared.groupBy("block")).applyInArrow(close, out)


def spans(starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by windows at sorted ``starts``: first units and ends."""
    if not len(starts):
        return starts, starts
    fresh = np.flatnonzero(starts[1:] > starts[:-1] + width)
    first = np.concatenate(([0], fresh + 1))
    last = np.append(fresh, len(starts) - 1)
    return starts[first], starts[last] + width


def kept_spans(starts: np.ndarray, width: int, total: int) -> tuple[list[tuple[int, int]], int, int]:
    """What is left of ``total`` units, how many units go, and in how many runs."""
    a, b = spans(starts, width)
    kept = list(zip([0, *b.tolist()], [*a.tolist(), total]))
    return kept, int((b - a).sum()), len(a)
