"""Removal of repeated word sequences by suffix automata of reference shards.

The reference of a document is every earlier one, so its shards are dealt out by the anchor of their
windows and not broadcast whole: a shard is the passages under one anchor, and its automaton stands in
the task to which the documents' passages with that anchor stream.  Passages come in the order of their documents.  Each streams
through the automaton of all earlier documents for its matching statistics (the longest match that
ends at each word), then joins the automaton itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .repeats import Words, covered_starts, kept_spans


class SuffixAutomaton:
    """All factors of the sequences added so far."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, q: int, symbol) -> int:
        """The state of the strings through ``p`` alone, taken out of ``q``."""
        nexts, link = self.next, self.link
        clone = self._state(self.length[p] + 1, link[q], dict(nexts[q]))
        link[q] = clone
        while p >= 0 and nexts[p].get(symbol) == q:
            nexts[p][symbol] = clone
            p = link[p]
        return clone

    def add(self, sequence) -> None:
        nexts, link, length = self.next, self.link, self.length
        last = 0
        for symbol in sequence:
            q = nexts[last].get(symbol)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._split(last, q, symbol)
                continue
            new = self._state(length[last] + 1, 0, {})
            p = last
            while p >= 0 and symbol not in nexts[p]:
                nexts[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = nexts[p][symbol]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, q, symbol)
            last = new

    def statistics(self, sequence) -> list[int]:
        """For each position, the length of the longest factor that ends there."""
        nexts, link, length = self.next, self.link, self.length
        state, matched, out = 0, 0, []
        for symbol in sequence:
            while state and symbol not in nexts[state]:
                state = link[state]
                matched = length[state]
            if symbol in nexts[state]:
                state = nexts[state][symbol]
                matched += 1
            out.append(matched)
        return out


def matching_statistics(width: int):
    """The matcher of word passages: for each window, whether an earlier document has its words."""

    def match(anchors, ranks, counts, data: bytes, ends):
        view = memoryview(data)
        texts = [bytes(view[a:b]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
        first_window = (np.cumsum(counts) - counts).tolist()
        flags = np.zeros(int(counts.sum()), bool)
        order = np.lexsort((ranks, anchors)).tolist()
        ranks, anchors, counts = ranks.tolist(), anchors.tolist(), counts.tolist()
        at = 0
        while at < len(order):
            # The passages of one anchor, in the order of their documents.
            end = at + 1
            while end < len(order) and anchors[order[end]] == anchors[order[at]]:
                end += 1
            first: dict[bytes, int] = {}
            open_: list[int] = []
            for i in order[at:end]:
                if first.setdefault(texts[i], ranks[i]) < ranks[i]:
                    # A later copy of a whole passage.
                    flags[first_window[i] : first_window[i] + counts[i]] = True
                else:
                    open_.append(i)
            at = end
            if len(first) > 1:
                stream(open_, texts, ranks, counts, first_window, flags)
        return flags

    def stream(passages, texts, ranks, counts, first_window, flags) -> None:
        automaton, waiting, now = SuffixAutomaton(), [], ranks[passages[0]]
        last = ranks[passages[-1]]
        for i in passages:
            if ranks[i] != now:
                for words in waiting:
                    automaton.add(words)
                waiting, now = [], ranks[i]
            words = texts[i].split()
            if len(automaton.link) > 1:
                found = automaton.statistics(words)
                start = first_window[i]
                flags[start : start + counts[i]] = np.array(found[width - 1 :]) >= width
            if now != last:
                waiting.append(words)

    return match


def remove_known_words(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document without the words covered by a window of ``width`` words that an earlier one has too.

    Returns the id, ``kept`` (the words left, joined by one blank), ``n_words``, ``n_removed`` and
    ``n_spans``.  Words stand between ASCII white space and are compared unchanged; a missing text has
    none.  Earlier means a smaller id; windows never cross documents and are judged on the input.
    Rows that share an id do not count as earlier for each other; a row without an id comes after all
    others.  An empty table gives no rows; other columns are ignored.
    """
    out = T.StructType(
        [T.StructField(id_col, T.LongType()), T.StructField("kept", T.BinaryType())]
        + [T.StructField(n, T.LongType()) for n in ("n_words", "n_removed", "n_spans")]
    )

    def finish(block, covered):
        rows = []
        for n, words in enumerate(block.parts):
            kept, removed, runs = kept_spans(covered(n), width, len(words))
            left = b" ".join([w for a, b in kept for w in words[a:b]])
            rows.append((block.ids[n], left, len(words), removed, runs))
        columns = list(zip(*rows))
        types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [id_col, "kept", "n_words", "n_removed", "n_spans"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types)})

    return covered_starts(docs, width, Words, matching_statistics(width), finish, out, id_col, text_col)
