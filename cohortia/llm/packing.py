"""Packing of tokenized documents into sequences of a fixed length by minimum bin slack.

Documents are cut into windows of the full length and one rest.  Full windows are sequences by
themselves.  The rests of a hash bucket are packed by their lengths alone: the longest open length
starts a sequence, a bitset over sums finds the multiset of open lengths that fills the remainder
closest to its end, the path back through the bitsets gives how often each length is used, and the
found multiset is applied as many times as the counts allow.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import buckets_for, col, process_cache, whole_text

MOST_WORDS = 500_000
# The split pattern of the tokenizer file, and the same for texts of ASCII alone.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")


class WordEncoder:
    """Ids of a tokenizer that lower-cases, splits into words and encodes each word by itself.

    The ids of a word never depend on its neighbours, so a worker encodes a distinct word once and
    keeps it.  ``encode`` gives the ids of each text as little-endian unsigned 32-bit values.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.specials = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")
        vocabulary = self.tokenizer.get_vocab()
        # Every word ends in a token of its own kind, by which the ids of many words come apart again.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        # The tokenizer lower-cases character by character, without the rule for a final sigma.
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def split(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.words(text)
        out = []
        for part in self.cut.split(text):
            out += [part] if part in self.specials else self.words(part)
        return out

    def word_ids(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        stop = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(stop) != len(words) or stop[-1] != 4 * len(ids):
            return [np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
        data, stop = ids.tobytes(), stop.tolist()
        return [data[a:b] for a, b in zip([0, *stop], stop)]

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [self.split(t) for t in texts]
        if len(self.known) > MOST_WORDS:
            self.known = {}
        if not self.known:
            self.known.update(self.specials)
        new = list(set().union(*words).difference(self.known))
        for at in range(0, len(new), 10_000):
            part = new[at : at + 10_000]
            self.known.update(zip(part, self.word_ids(part)))
        get = self.known.__getitem__
        return [b"".join(map(get, w)) for w in words]


def fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of open lengths with the largest sum up to ``room``, as length -> how often.

    ``lengths`` are the open ones, descending.  Bit s of a bitset says that the lengths so far can sum
    to s; each item adds its length by a shift.  It ends as soon as the room can be filled exactly.
    """
    mask, target = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(counts[length], room // length)):
            longer = (reach | reach << length) & mask
            if longer == reach:
                break
            steps.append((length, reach))
            reach = longer
            if reach & target:
                break
        if reach & target:
            break
    at, used = reach.bit_length() - 1, {}
    # Backtrack: an item was needed where the sum could not be reached without it.
    for length, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + 1
            at -= length
    return used


def slack_patterns(counts: dict[int, int], size: int) -> list[tuple[dict[int, int], int]]:
    """(multiset of lengths, how many sequences have it), until every length is used up."""
    counts = {length: n for length, n in counts.items() if n}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        used = fill(lengths, counts, size - first)
        counts[first] += 1
        used[first] = used.get(first, 0) + 1
        times = min(counts[length] // n for length, n in used.items())
        out.append((used, times))
        for length, n in used.items():
            counts[length] -= n * times
            if not counts[length]:
                lengths.remove(length)
    return out


def place(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece of one bucket."""
    order = np.argsort(lengths, kind="stable")
    values, starts = np.unique(lengths[order], return_index=True)
    ends = dict(zip(values.tolist(), np.append(starts[1:], len(order)).tolist()))
    queue = dict(zip(values.tolist(), starts.tolist()))
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    number = 0
    for used, times in slack_patterns({v: ends[v] - queue[v] for v in ends}, size):
        at = 0
        for length, n in used.items():
            for _ in range(n):
                items = order[queue[length] : queue[length] + times]
                sequence[items] = number + np.arange(times)
                offset[items] = at
                queue[length] += times
                at += length
        number += times
    return sequence, offset


def pack(
    docs: DataFrame,
    path: str,
    size: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    docs_per_bucket: int = 8192,
) -> DataFrame:
    """Pieces of documents in sequences of ``size`` tokens.

    One row per piece: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``
    and ``offset``.  A document has the ids of the tokenizer file at ``path`` and then ``end_id``, so a
    missing or empty text is one id.  Repeated rows and ids are packed each; an id may be missing;
    other columns are ignored.  Pieces meet in hash buckets of about ``docs_per_bucket`` documents;
    each bucket numbers its own sequences and may leave its last ones short.
    """
    given = docs.select(col(id_col).alias("id"), whole_text(text_col).alias("text"))
    buckets = buckets_for(docs.count(), docs_per_bucket)
    id_field = T.StructField("id", given.schema["id"].dataType)
    longs = [T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens")]
    cut_type = T.StructType([id_field, *longs])
    last = np.array([end_id], "<u4").tobytes()

    def cut(batches):
        encoder = process_cache(f"words {path}", lambda: WordEncoder(path))
        for b in batches:
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), 256):
                take, start, length, crc, total = [], [], [], [], []
                for n, ids in enumerate(encoder.encode(texts[at : at + 256]), at):
                    ids += last
                    for s in range(0, len(ids), 4 * size):
                        piece = ids[s : s + 4 * size]
                        take.append(n)
                        start.append(s // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                ids = b.column(0).take(pa.array(take, pa.int64()))
                arrays = [ids] + [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in cut_type])

    def place_bucket(rows: pd.DataFrame) -> pd.DataFrame:
        # Rows come in any order; this one makes a recomputed task give the same sequences.
        rows = rows.sort_values(["ids_crc32", "start", "id", "doc_tokens"], kind="stable")
        number, offset = place(rows["length"].to_numpy(), size)
        return rows.assign(sequence_id=rows["bucket"].to_numpy() * 2**32 + number, offset=offset).drop(columns="bucket")

    out_type = T.StructType([id_field, *longs, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    bucket = F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets))
    pieces = given.mapInArrow(cut, cut_type).withColumn("bucket", bucket)
    return pieces.groupBy("bucket").applyInPandas(place_bucket, out_type).withColumnRenamed("id", id_col)
