"""Repeat removal against brute force over every window."""

import numpy as np
import pytest

from cohortia.llm import repeats
from cohortia.llm.automata import SuffixAutomaton, remove_known_words
from cohortia.llm.suffixes import earlier_in_runs, remove_repeats, suffix_classes

from llm_helpers import corpus

FAR = float("inf")


def brute(rows, width, read, join):
    units = [(FAR if i is None else i, read((t or "").encode())) for i, t in rows]
    first = {}
    for i, u in units:
        for s in range(len(u) - width + 1):
            key = bytes(u[s : s + width]) if isinstance(u, bytes) else tuple(u[s : s + width])
            first[key] = min(first.get(key, FAR), i)
    out = []
    for (i, u), (given, _) in zip(units, rows):
        gone = [False] * len(u)
        for s in range(len(u) - width + 1):
            key = bytes(u[s : s + width]) if isinstance(u, bytes) else tuple(u[s : s + width])
            if first[key] < i:
                gone[s : s + width] = [True] * width
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        kept = join([x for x, g in zip(u, gone) if not g])
        out.append((given, kept, len(u), sum(gone), runs))
    return sorted(out, key=str)


def found(df, kept, total):
    rows = df.select("doc_id", kept, total, "n_removed", "n_spans").collect()
    return sorted(((r[0], bytes(r[1]), *r[2:]) for r in rows), key=str)


@pytest.fixture(params=["ordinary", "hot"])
def route(request, monkeypatch):
    """Windows travel in passages, or one by one as under very frequent anchors; blocks are small in both."""
    monkeypatch.setattr(repeats, "BLOCK_BYTES", 3000)
    if request.param == "hot":
        monkeypatch.setattr(repeats, "HOT", 2)


def test_bytes_against_every_window(docs_of, route):
    rows = corpus()
    df = remove_repeats(docs_of(rows, kept="clash", shard=1, block=2), width=50)
    assert found(df, "kept", "n_bytes") == brute(rows, 50, bytes, bytes)


def test_words_against_every_window(docs_of, route):
    rows = corpus(seed=6)
    df = remove_known_words(docs_of(rows, kept="clash", shard=1, block=2), width=13)
    assert found(df, "kept", "n_words") == brute(rows, 13, bytes.split, b" ".join)


def test_carried_columns_keep_their_rows(docs_of):
    rows = [(1, "x" * 70), (2, "é" * 10 + "x" * 70), (3, None)]
    got = remove_repeats(docs_of(rows, id="own"), width=50, carry=["lang", "id", "n_chars"]).collect()
    assert {(r["doc_id"], r["kept_text"], r["carried"]["id"], r["carried"]["n_chars"]) for r in got} == {
        (1, "x" * 70, "own", 70), (2, "é" * 10, "own", 80), (3, "", "own", None)
    }


def test_empty_table(docs_of):
    assert remove_repeats(docs_of([])).count() == 0
    assert remove_known_words(docs_of([])).count() == 0


def test_suffix_classes_order_all_windows():
    text = np.frombuffer(b"abracadabra-abracadabra" * 4, np.uint8)
    for width in (1, 5, 8, 13, 50):
        classes = suffix_classes(text, width)
        padded = text.tobytes() + bytes(width)
        words = [padded[i : i + width] for i in range(len(text))]
        assert [sorted(set(words)).index(w) for w in words] == [sorted(set(classes)).index(c) for c in classes]


def test_previous_and_next_smaller_inside_runs():
    rng = np.random.default_rng(1)
    runs = np.sort(rng.integers(0, 9, 60))
    owners = rng.integers(0, 6, 60)
    exact = [any(owners[j] < owners[i] for j in range(60) if runs[j] == runs[i]) for i in range(60)]
    assert earlier_in_runs(runs, owners).tolist() == exact


def test_matching_statistics():
    rng = np.random.default_rng(2)
    parts = [rng.integers(0, 3, 15).tolist() for _ in range(5)]
    automaton = SuffixAutomaton()
    for part in parts:
        automaton.add(part)
    known = {tuple(p[a:b]) for p in parts for a in range(15) for b in range(a + 1, 16)}
    probe = rng.integers(0, 3, 60).tolist()
    exact = [max(n for n in range(i + 2) if n == 0 or tuple(probe[i + 1 - n : i + 1]) in known) for i in range(60)]
    assert automaton.statistics(probe) == exact
