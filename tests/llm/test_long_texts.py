"""Texts longer than a block, a batch or a chunk of any operator."""

import hashlib
import random

import pytest

from cohortia.llm.automata import remove_known_words
from cohortia.llm.decontaminate import contamination
from cohortia.llm.neardup import near_duplicates
from cohortia.llm.repeats import BLOCK_BYTES
from cohortia.llm.suffixes import remove_repeats
from cohortia.llm.toxicity import fit_toxicity, score_toxicity


@pytest.fixture(scope="module")
def long_rows():
    """A text of three blocks, a near copy, one that shares a passage, and the passage alone."""
    rng = random.Random(12)
    words = [f"{rng.choice('abcdefghij')}{rng.randrange(10**6)}" for _ in range(400_000)]
    text = " ".join(words)
    assert len(text) > 3 * BLOCK_BYTES
    copy = list(words)
    copy[200_000] = "changed"
    part = words[123_456:123_556]
    own = [f"z{i}" for i in range(50)]
    return [(1, text), (2, " ".join(copy)), (3, " ".join(own + part + own[::-1])), (4, " ".join(part))]


def test_near_duplicates_of_long_texts(docs_of, long_rows):
    got = {r["doc_id"]: r for r in near_duplicates(docs_of(long_rows)).collect()}
    assert [got[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 3, 4]
    assert got[1]["n_shingles"] == 400_000 - 3


def test_repeats_of_long_texts(docs_of, long_rows):
    got = {r["doc_id"]: r for r in remove_repeats(docs_of(long_rows), width=50).collect()}
    text, copy, mixed, part = (t.encode() for _, t in long_rows)
    assert got[1]["n_removed"] == 0 and hashlib.sha256(bytes(got[1]["kept"])).digest() == hashlib.sha256(text).digest()
    # Of the copy only what differs stays; of the third text its own words.
    assert len(got[2]["kept"]) < 20 and b"changed" in bytes(got[2]["kept"]) and got[2]["n_spans"] == 2
    assert got[2]["n_bytes"] == len(copy) and got[3]["n_removed"] >= len(part) and got[4]["kept"] == b""
    words = {r["doc_id"]: r for r in remove_known_words(docs_of(long_rows), width=13).collect()}
    assert [words[i]["n_removed"] for i in (1, 2, 3, 4)] == [0, 399_999, 100, 100]
    assert bytes(words[2]["kept"]) == b"changed" and words[1]["n_words"] == 400_000


def test_benchmark_passages_in_long_texts(spark, docs_of, long_rows):
    benchmark = spark.createDataFrame([(7, long_rows[3][1]), (8, "not in any of them, " * 6)], "item_id long, text string")
    got = {r["doc_id"]: list(r["item_ids"]) for r in contamination(docs_of(long_rows), benchmark).collect()}
    assert got == {1: [7], 2: [7], 3: [7], 4: [7]}


def test_scores_of_long_texts(spark, docs_of, long_rows):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["good", "day", "tree", "vilestuff" if i % 3 == 0 else "sun"]) for _ in range(40))) for i in range(10, 400)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in docs], "doc_id long, toxic int")
    shouting = (500, "vilestuff good day " * 200_000)
    df = docs_of(docs + long_rows + [shouting])
    model = fit_toxicity(df, labels, least=15)
    scored = {r["doc_id"]: r["score"] for r in score_toxicity(df, model).collect()}
    assert scored[500] > 0.5 and all(scored[i] < 0.5 for i in (1, 2, 3, 4))
