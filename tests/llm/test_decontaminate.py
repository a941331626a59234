"""Benchmark passages: alignment and filter against plain edit distance."""

import random

import numpy as np
import pytest

from cohortia.llm import decontaminate
from cohortia.llm.decontaminate import aligned, contamination, find_regions, make_probes, normal, regions


def best_match(probe, text):
    """Fewest edits between the probe and any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(probe, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = rng.choice("xyz")
        elif kind == 1:
            del out[at]
        else:
            out.insert(at, rng.choice("xyz"))
    return "".join(out)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice([8, 20, 45])))) for k in range(12)], words


def test_alignment_equals_edit_distance():
    rng = random.Random(1)
    for _ in range(150):
        probe = "".join(rng.choice("ab") for _ in range(rng.randint(3, 14)))
        text = "".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))
        edits, start, end = aligned(normal(probe), normal(text), -len(probe), len(text))
        assert edits == best_match(probe, text)
        assert 0 <= start <= end <= len(text)
        assert best_match(probe, text[start:end]) == edits


def test_every_passage_within_the_budget_is_found(items):
    rng = random.Random(2)
    benchmark, words = items
    probes = make_probes(benchmark, 64, 0.1, 8)
    for _ in range(120):
        p = rng.randrange(len(probes.texts))
        probe = probes.texts[p].tobytes().decode("utf-32-le")
        inside = edited(rng, probe, rng.randint(0, int(probes.budgets[p])))
        noise = lambda: " ".join(rng.choice(words) + "q" for _ in range(rng.randint(0, 60)))
        text = f"{noise()} {inside} {noise()}"
        exact = best_match(probe, " ".join(text.lower().split()))
        found = [r for r in regions(text, probes) if r[0] == probes.items[p]]
        if exact <= probes.budgets[p]:
            assert found and min(r[3] for r in found) <= exact


def test_clean_texts_stay_clean(items):
    rng = random.Random(3)
    benchmark, words = items
    probes = make_probes(benchmark, 64, 0.1, 8)
    for _ in range(30):
        text = " ".join(rng.choice(words) for _ in range(400))
        for item, _, _, edits in regions(text, probes):
            own = [p for p in range(len(probes.texts)) if probes.items[p] == item]
            assert min(best_match(probes.texts[p].tobytes().decode("utf-32-le"), text) for p in own) <= edits


@pytest.mark.parametrize("share", [10**6, 300])
def test_table_in_one_or_many_shares(spark, docs_of, items, monkeypatch, share):
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", share)
    benchmark, _ = items
    given = spark.createDataFrame([*benchmark, (90, None), (None, benchmark[0][1]), (91, "short")], "item_id long, text string")
    long = next(t for _, t in benchmark if len(t) > 150)
    number = next(k for k, t in benchmark if t == long)
    rows = [(1, "Intro. " + long.upper().replace(" ", " \n")), (2, "nothing here"), (3, ""), (4, None), (4, long), (None, long[10:120])]
    got = {(r["doc_id"], r["contaminated"], tuple(r["item_ids"])) for r in contamination(docs_of(rows, regions=1, item_id=2), given).collect()}
    assert got == {(1, True, (number,)), (2, False, ()), (3, False, ()), (4, False, ()), (4, True, (number,)), (None, True, (number,))}
    assert contamination(docs_of([]), given).count() == 0
    assert contamination(docs_of(rows), given.limit(0)).where("contaminated").count() == 0
    with pytest.raises(ValueError, match="regions"):
        find_regions(docs_of(rows, regions=1), given)


def test_positions(items):
    benchmark, _ = items
    probes = make_probes(benchmark[:3], 64, 0.1, 8)
    text = "zzz " + benchmark[0][1]
    whole = "".join(map(chr, normal(text)))
    for _, start, end, edits in regions(text, probes):
        assert edits == 0 or end > start
        if edits == 0:
            assert whole[start:end] in benchmark[0][1]
    assert np.array_equal(normal(" A\n b "), normal("a b"))


@pytest.mark.parametrize("length", [64, 70, 75, 82])
def test_every_verbatim_passage_of_a_probe_is_found(items, length):
    """At every offset of every long item, as plain search finds it."""
    benchmark, _ = items
    probes = make_probes(benchmark, 64, 0.1, 8)
    for number, text in benchmark:
        text = " ".join(text.split())
        for at in range(len(text) - length + 1):
            passage = text[at : at + length].strip()
            if len(passage) >= 64:
                found = regions(f"ZQX9 {passage} 7WVU", probes)
                assert number in {r[0] for r in found}, (number, at)
