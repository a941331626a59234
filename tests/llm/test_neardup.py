"""Near-duplicate groups against all pairs; the forest's stretches; components."""

import random

import numpy as np
import pytest

from cohortia.llm import neardup
from cohortia.llm.components import components
from cohortia.llm.neardup import near_duplicates, set_links, shingle_set, spanning

from llm_helpers import corpus


def shingles(text, width):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width):
    sets = [shingles(t, width) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if ids[a] is not None and ids[b] is not None and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(ids[a]), root(ids[b])
                parent[max(x, y)] = min(x, y)
    out = []
    for i, s in zip(ids, sets):
        component = None if i is None else root(i)
        out.append((i, len(s), component, component is None or component == i))
    return sorted(out, key=str)


@pytest.mark.parametrize("width", [4, 5])
def test_groups_equal_all_pairs(docs_of, width):
    rows = corpus(seed=width, words=60)
    got = near_duplicates(docs_of(rows, id="x", key="y", component_id=0, sign=1), width=width)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, width)


def test_a_crowded_group_in_short_stretches(docs_of, monkeypatch):
    """Many drifting copies of one text, compared only with near neighbours in each order."""
    monkeypatch.setattr(neardup, "STRETCH", 16)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):
        copy = list(base)
        for at in rng.sample(range(120), rng.randint(0, 4)):
            copy[at] = f"other{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    got = near_duplicates(docs_of(rows))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 4)


def test_empty_and_only_unlinked(docs_of):
    assert near_duplicates(docs_of([])).count() == 0
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two")]
    assert sorted(tuple(r) for r in near_duplicates(docs_of(rows)).collect()) == [
        (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True)
    ]


def test_links_decide_at_the_exact_share():
    a = np.arange(10, dtype=np.uint64)
    b, c = a[:8].copy(), a[:7].copy()
    links = set_links(80)([a.tobytes(), b.tobytes(), c.tobytes()])
    assert links[0, 1] and not links[0, 2] and links[1, 2]


def test_spanning_forest():
    linked = np.zeros((6, 6), bool)
    for x, y in ((0, 1), (1, 2), (0, 2), (4, 5)):
        linked[x, y] = linked[y, x] = True
    edges = spanning(np.arange(10, 16), linked)
    assert len(edges) == 3 and {frozenset(e) for e in edges} <= {frozenset(p) for p in ((10, 11), (11, 12), (10, 12), (14, 15))}


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components(spark, shape):
    rng = random.Random(4)
    edges = {
        "chain": [(k, k + 1) for k in range(40)],
        "star": [(7, k) for k in range(60)] + [(100, 101)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
    }[shape]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: label[v] for v in linked}


def template_group(n=260, words=120, planted=12):
    """Texts of one template at about 0.72 to each other, with pairs at about 0.85 among them."""
    rng = random.Random(8)
    base = [f"w{k}" for k in range(words)]

    def changed(text, places):
        out = list(text)
        for at in places:
            out[at] = f"own{rng.randrange(10**9)}"
        return out

    # Five lone words change twenty of 117 shingles; one more in a copy changes four.
    texts = [changed(base, rng.sample(range(4, words - 4, 5), 5)) for _ in range(n)]
    texts += [changed(t, [next(k for k in range(4, words - 4, 5) if t[k] == base[k])]) for t in rng.sample(texts, planted)]
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_a_large_template_group_is_confirmed_whole(docs_of, monkeypatch):
    # Few short labels leave the group in crowds that stretches of four do not cover.
    for name, value in {"STRETCH": 4, "TREES": 4, "LEVELS": 1, "DEPTH": 1, "BLOCK": 32}.items():
        monkeypatch.setattr(neardup, name, value)
    rows = template_group()
    want = brute(rows, 4)
    assert sum(not r[3] for r in want) == 12
    assert sorted((tuple(r) for r in near_duplicates(docs_of(rows)).collect()), key=str) == want


def test_the_rest_alone_finds_every_pair(spark):
    """No home is shared, so every link comes from the prefix join."""
    rows = corpus(seed=12, n=40, words=60)
    sets = {i: shingle_set((t or "").encode(), 4) for i, t in rows if i is not None}
    sets = {i: s for i, s in sets.items() if len(s)}
    given = spark.createDataFrame([(i, i, bytearray(s.tobytes())) for i, s in sets.items()], "id long, home long, shingles binary")
    got = {(r["a"], r["b"]) for r in neardup.exact_rest(given, 80, 4).collect()}
    want = set()
    for a, x in sets.items():
        for b, y in sets.items():
            both = len(np.intersect1d(x, y))
            if a < b and both and 100 * both >= 80 * (len(x) + len(y) - both):
                want.add((a, b))
    assert got == want and len(want) > 10
