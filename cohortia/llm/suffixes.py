"""Removal of repeated byte strings by longest previous factors in suffix order.

Of a shard's passages, identical ones are settled by their hash: only the first keeps anything.  The
windows of the others are the suffixes of one text.  Doubling orders the suffixes by their first
bytes up to the window width; where neighbours in that order agree in all of them, the longest common
prefix reaches the width.  A suffix then has an earlier match of that length exactly if, inside its
run of such neighbours, the previous smaller or the next smaller document exists.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .repeats import Bytes, covered_starts, kept_spans, ranges

CHUNK_BYTES = 500_000


def dense(keys: np.ndarray) -> np.ndarray:
    """Order-preserving small numbers for values."""
    return np.unique(keys, return_inverse=True)[1].astype(np.uint64)


def suffix_classes(text: np.ndarray, width: int) -> np.ndarray:
    """For each position, the place of its first ``width`` bytes among all such, equal ones sharing it."""
    padded = np.concatenate((text, np.zeros(width, np.uint8)))
    n = 1
    classes = padded.astype(np.uint64)
    while n < 8 and 2 * n <= width:
        classes = classes[:-n] << np.uint64(8 * n) | classes[n:]
        n *= 2
    classes = dense(classes)
    while n < width:
        step = min(n, width - n)
        classes = dense(classes[:-step] << np.uint64(32) | classes[step:])
        n += step
    return classes[: len(text)]


def earlier_in_runs(runs: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Whether a smaller owner stands before or after, inside the same run, in suffix order.

    ``runs`` is ascending.  Running minima from the left give the previous smaller value, from the
    right the next smaller one; an offset per run makes both start afresh.
    """
    if not len(runs):
        return np.zeros(0, bool)
    place = np.unique(owners, return_inverse=True)[1].astype(np.int64)
    far = np.int64(len(owners) + 1)
    left = np.minimum.accumulate(place - runs * far) + runs * far
    back = runs[-1] - runs
    right = (np.minimum.accumulate((place - back * far)[::-1]) + (back * far)[::-1])[::-1]
    return (left < place) | (right < place)


def previous_factors(width: int):
    """The matcher of byte passages: for each window, whether an earlier document has its bytes."""

    def windows_found(texts, starts, ends, n, ranks) -> np.ndarray:
        """For the windows of some passages, whether another one has them and a smaller owner."""
        text = np.frombuffer(b"".join(bytes(texts[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint8)
        size = ends - starts
        window = ranges(np.cumsum(size) - size, n)
        classes = suffix_classes(text, width)[window].astype(np.int64)
        by = np.argsort(classes, kind="stable")
        runs = np.cumsum(np.concatenate(([0], np.diff(classes[by]) > 0)))
        found = np.zeros(len(window), bool)
        found[by] = earlier_in_runs(runs, np.repeat(ranks, n)[by])
        return found

    def match(anchors, ranks, counts, data: bytes, ends):
        lengths = counts + (width - 1)
        texts = memoryview(data)
        starts = ends - lengths
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(texts[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))
        first_window = np.cumsum(counts) - counts
        order = np.lexsort((ranks, hashes, anchors))
        fresh = np.ones(len(order), bool)
        a, h = anchors[order], hashes[order]
        fresh[1:] = (a[1:] != a[:-1]) | (h[1:] != h[:-1])
        group = np.cumsum(fresh) - 1
        least = ranks[order][fresh]
        later = ranks[order] > least[group]
        flags = np.zeros(int(counts.sum()), bool)
        # Later copies of a whole passage are covered; anchors with one content have nothing else to meet.
        contents = np.unique(a[fresh], return_inverse=True, return_counts=True)
        several = contents[2][contents[1]] > 1
        open_groups = group[fresh & several[group]]
        open_passages = order[fresh & several[group]]
        firsts = {}
        # Equal windows have equal anchors: whole anchors at a time bound the arrays of the suffix order.
        size = lengths[open_passages]
        heads = np.unique(anchors[open_passages], return_index=True)[1]
        chunk = (np.cumsum(size) - size)[heads] // CHUNK_BYTES
        cuts = heads[np.diff(chunk, prepend=-1) > 0].tolist()
        for begin, end in zip(cuts, [*cuts[1:], len(open_passages)]):
            these = open_passages[begin:end]
            n = counts[these]
            found = windows_found(texts, starts[these], ends[these], n, ranks[these])
            bounds = np.cumsum(n) - n
            for g, s, c in zip(open_groups[begin:end].tolist(), bounds.tolist(), n.tolist()):
                firsts[g] = found[s : s + c]
        for i, g, is_later in zip(order.tolist(), group.tolist(), later.tolist()):
            if is_later:
                flags[first_window[i] : first_window[i] + counts[i]] = True
            elif g in firsts:
                flags[first_window[i] : first_window[i] + counts[i]] = firsts[g]
        return flags

    return match


def remove_repeats(
    docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None
) -> DataFrame:
    """Every document without the bytes covered by a ``width``-byte string that an earlier one has too.

    Returns the id, ``kept`` (binary), ``n_bytes``, ``n_removed`` and ``n_spans``; with ``carry``, also a
    struct ``carried`` of these columns of ``docs`` and ``kept_text``, the kept bytes as text without
    the parts of characters that were cut.  A text is its UTF-8 bytes, a missing one none.  Earlier means
    a smaller id; matches never cross documents and are judged on the input.  Rows that share an id do
    not count as earlier for each other; a row without an id comes after all others.  An empty table
    gives no rows; other columns are ignored.
    """
    carry = carry or []
    fields = [T.StructField("id", T.LongType()), T.StructField("kept", T.BinaryType())]
    fields += [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")]
    if carry:
        fields.append(T.StructField("kept_text", T.StringType()))
        fields.append(T.StructField("carried", T.StructType([docs.schema[c] for c in carry])))

    def finish(block, covered):
        rows = []
        for n, text in enumerate(block.texts):
            kept, removed, runs = kept_spans(covered(n), width, len(text))
            rows.append((b"".join(text[a:b] for a, b in kept), len(text), removed, runs))
        kept, sizes, removed, runs = zip(*rows)
        columns = {"id": pa.array(block.ids, pa.int64()), "kept": pa.array(kept, pa.binary())}
        columns |= {n: pa.array(v, pa.int64()) for n, v in (("n_bytes", sizes), ("n_removed", removed), ("n_spans", runs))}
        if carry:
            columns["kept_text"] = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())
            columns["carried"] = block.carried
        return pa.table(columns)

    found = covered_starts(docs, width, Bytes, previous_factors(width), finish, T.StructType(fields), id_col, text_col, carry)
    return found.withColumnRenamed("id", id_col)
