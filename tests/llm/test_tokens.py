"""Token counts and packing against the tokenizer library."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cohortia.llm.packing import WordEncoder, fill, pack, place, slack_patterns
from cohortia.llm.tokencount import Transducer, token_counts

from llm_helpers import corpus

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PIECES = ["'s", "'re", "'", "r", "l", "v", " ", "  ", "\n", "\t", "a", "é", "1", "²", "!", "<|endoftext|>", "<|endof", "中", "\xa0"]
PIECES += ["'ll", "ing", "😀", "text|>", "\x85", "ΑΣ", "Σ", "İ", "_", "\x1c", "½", "ß", "<|startoftext|>", "É", "é"]


@pytest.fixture(scope="module")
def machine():
    return Transducer(BYTES)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


def plain(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=14).map("".join))
def test_counts_equal_the_library(text):
    machine = test_counts_equal_the_library.__dict__.setdefault("machine", Transducer(BYTES))
    library = test_counts_equal_the_library.__dict__.setdefault("library", Tokenizer.from_file(BYTES))
    assert machine.count(text) == plain(library, text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=6).map("".join), min_size=1, max_size=5))
def test_state_maps_compose_in_any_grouping(chunks):
    machine = test_counts_equal_the_library.__dict__.setdefault("machine", Transducer(BYTES))
    maps = [machine.state_map(c) for c in chunks]
    left = maps[0]
    for m in maps[1:]:
        left = machine.compose(left, m)
    right = maps[-1]
    for m in reversed(maps[:-1]):
        right = machine.compose(m, right)
    assert machine.total(left) == machine.total(right) == machine.count("".join(chunks))


def test_a_worker_may_forget_transitions(machine, byte_library, monkeypatch):
    from cohortia.llm import tokencount

    monkeypatch.setattr(tokencount, "MOST_TRANSITIONS", 20)
    monkeypatch.setattr(tokencount, "MOST_PATHS", 3)
    texts = [t or "" for _, t in corpus()]
    small = Transducer(BYTES)
    assert [small.count(t) for t in texts] == [plain(byte_library, t) for t in texts]


@pytest.mark.parametrize("chunk", [7, 40, 10_000])
def test_token_counts_of_a_table(docs_of, byte_library, chunk):
    rows = corpus() + [(900, "x" * 300), (901, " ".join(["word\n\n more"] * 50)), (901, " ".join(["word\n\n more"] * 50))]
    got = token_counts(docs_of(rows, n_tokens="clash", id=1, key=2), BYTES, chunk=chunk)
    exact = sorted(((i, len((t or "").encode()), plain(byte_library, t or "")) for i, t in rows), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == exact
    assert token_counts(docs_of([]), BYTES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=10).map("".join), max_size=4))
def test_word_ids_equal_the_library(texts):
    own = test_word_ids_equal_the_library.__dict__.setdefault("own", WordEncoder(WORDS))
    library = test_word_ids_equal_the_library.__dict__.setdefault("library", Tokenizer.from_file(WORDS))
    exact = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert own.encode(texts) == exact


def test_fill_is_the_best_subset():
    rng = random.Random(1)
    for _ in range(200):
        lengths = sorted({rng.randint(1, 30) for _ in range(6)}, reverse=True)
        counts = {n: rng.randint(1, 3) for n in lengths}
        room = rng.randint(0, 60)
        sums = {0}
        for n in lengths:
            for _ in range(counts[n]):
                sums |= {s + n for s in sums if s + n <= room}
        used = fill(lengths, counts, room)
        assert sum(n * k for n, k in used.items()) == max(sums)
        assert all(k <= counts[n] for n, k in used.items())


def test_patterns_use_every_length_once():
    rng = random.Random(2)
    counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, 2049), 300)}
    left = dict(counts)
    for used, times in slack_patterns(counts, 2048):
        assert sum(n * k for n, k in used.items()) <= 2048
        for n, k in used.items():
            left[n] -= k * times
    assert not any(left.values())


def test_placing_leaves_no_gap():
    lengths = np.random.default_rng(3).integers(1, 2049, 3000)
    sequence, offset = place(lengths, 2048)
    padding = 0
    for s in range(sequence.max() + 1):
        at = np.flatnonzero(sequence == s)
        at = at[np.argsort(offset[at])]
        assert offset[at].tolist() == [0, *np.cumsum(lengths[at])[:-1].tolist()]
        padding += 2048 - int(lengths[at].sum())
    assert 0 <= padding < 0.01 * lengths.sum()


@pytest.mark.parametrize("size", [16, 2048])
def test_pieces_of_a_table(docs_of, size):
    library = Tokenizer.from_file(WORDS)
    rows = corpus(seed=8)
    got = pack(docs_of(rows, start="clash", bucket=3, id=4), WORDS, size=size, docs_per_bucket=40).collect()
    exact = []
    for i, t in rows:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), size):
            part = ids[s : s + size]
            exact.append((i, s, len(part), zlib.crc32(part.tobytes()), len(ids)))
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(exact, key=str)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert pack(docs_of([]), WORDS).count() == 0
