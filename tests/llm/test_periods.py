"""Periodic runs against a search of every period at every place."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from cohortia.llm.periods import octaves, periodic_runs, planted_tail, run_digests, solve, tiles, word_codes, z_function

from llm_helpers import corpus, make_docs


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if words[p:] == words[: len(words) - p])


def brute_runs(words):
    """(start, length, period) of every run, by start, then period."""
    n = len(words)
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([codes[w] for w in words], np.int64)
    out = []
    for p in range(1, n // 3 + 1):
        same = np.concatenate(([False], x[:-p] == x[p:], [False]))
        start = np.flatnonzero(same[1:] & ~same[:-1])
        stop = np.flatnonzero(~same[1:] & same[:-1])
        for s, e in zip(start.tolist(), (stop + p).tolist()):
            if e - s >= max(24, 3 * p) and smallest_period(words[s:e]) == p:
                out.append((s, e - s, p))
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute(doc_id, text, planted):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if planted and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    gone = {i for s, k, p in runs for i in range(s + p, s + k)}
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    lines = "".join(f"{s},{k},{p}\n" for s, k, p in runs)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    milli = None if best[0] is None else 1000 * best[1] // best[2]
    digests = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in (lines, kept)]
    return doc_id, len(runs), *best, milli, *digests


def periodic_rows(seed):
    """Texts with runs of many periods: whole, cut, nested, adjoining, and almost long enough."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(40))
    text = lambda k: [word() for _ in range(k)]
    rows = []
    for i in range(60):
        out = []
        for _ in range(rng.randint(1, 4)):
            p = rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 100])
            root = text(p)
            if rng.random() < 0.3:
                root = root[: max(1, p // 2)] * 2
            length = rng.choice([2 * p, 3 * p - 1, 3 * p, 3 * p + 1, 24, 23, 25, 5 * p + p // 2, rng.randint(2, 9) * p])
            out += text(rng.randint(0, 40)) + (root * (length // len(root) + 1))[:length]
        rows.append((i, " ".join(out)))
    for i in range(60, 90):
        # Two words only: many runs that overlap and adjoin.
        rows.append((i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 150)))))
    rows += [(90, "a " * 500), (91, "a b " * 300 + "a"), (92, ("x y z " * 20 + "q ") * 20), (93, "a" * 50), (94, "é " * 23), (95, "é " * 24)]
    return rows


@pytest.mark.parametrize("planted", [False, True])
def test_runs_equal_brute_force(spark, planted):
    rows = periodic_rows(3) + [(i + 1000 if i is not None else None, t) for i, t in corpus()]
    docs = make_docs(spark, rows, start=1, runs="x", key=2, best=3)
    got = run_digests(periodic_runs(docs, tail=planted_tail if planted else None))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted((brute(i, t, planted) for i, t in rows), key=key)


def test_long_text_in_many_tiles(spark):
    """One text of many tiles, with a run over most of it, one inside a tile, and one across a border."""
    rng = random.Random(9)
    unique = iter(range(10**6))
    fresh = lambda k: [f"u{next(unique)}" for _ in range(k)]
    root = fresh(3001)
    words = fresh(4090) + fresh(5) * 7 + fresh(2000) + root * 5 + root[:77] + fresh(3) + ["s"] * 9000 + fresh(10) + (fresh(700) * 4)[:2100]
    got = periodic_runs(make_docs(spark, [(1, "\n".join(words)), (2, None)])).collect()
    whole = {r["doc_id"]: r for r in got}
    a = 4090 + 35 + 2000
    b = a + 5 * 3001 + 77 + 3
    expected = [(4090, 35, 5), (a, 5 * 3001 + 77, 3001), (b, 9000, 1), (b + 9010, 2100, 700)]
    assert [tuple(r) for r in whole[1]["runs"]] == expected
    assert whole[1]["n_words"] == len(words) and whole[2]["runs"] == []
    gone = {i for s, k, p in expected for i in range(s + p, s + k)}
    assert whole[1]["kept"].decode() == " ".join(w for i, w in enumerate(words) if i not in gone)


def test_tiles_of_any_size(monkeypatch):
    """Small tiles cut runs into many fragments; stitched by hand they are the runs."""
    from cohortia.llm import periods

    monkeypatch.setattr(periods, "TILE_WORDS", 1)
    for seed in range(6):
        for _, text in periodic_rows(seed):
            words = text.split()
            codes = word_codes(text.encode())
            pieces = sorted(f for t in tiles(codes) for f in solve(codes[t[3] : t[4]], *t[:4]))
            runs = {}
            for p, s, e in pieces:
                last = runs.setdefault(p, [])
                if last and s + p <= last[-1][1]:
                    last[-1][1] = max(last[-1][1], e)
                else:
                    last.append([s, e])
            found = {}
            for p in sorted(runs):
                for s, e in runs[p]:
                    if e - s >= max(24, 3 * p):
                        found.setdefault((s, e - s), p)
            assert sorted(((s, k, p) for (s, k), p in found.items()), key=lambda r: (r[0], r[2])) == brute_runs(words), text


def test_pieces_of_long_texts(monkeypatch):
    from cohortia.llm import periods

    text = ("word éé  x\n" * 300).encode()
    whole = word_codes(text)
    monkeypatch.setattr(periods, "PIECE", 7)
    assert (word_codes(text) == whole).all() and len(whole) == 900


def test_z_function_and_octaves():
    for s in ("", "a", "aaaa", "abcabcab", "abacaba"):
        z = z_function(list(s))
        assert all(z[i] == next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s)))
    assert octaves(23) == [] and octaves(24) == [2, 3] and octaves(48) == [2, 3, 4] and octaves(47) == [2, 3]


def test_nothing_from_nothing(spark):
    assert run_digests(periodic_runs(make_docs(spark, []))).count() == 0


def test_query_on_whole_table(spark, folder):
    from cohortia.llm.queries import REGISTRY

    got = REGISTRY["op11_period_runs"](spark, folder)
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    small = [r for r in rows if len(r["text"] or "") < 30_000]
    expected = {r["doc_id"]: brute(r["doc_id"], r["text"], True) for r in small}
    found = {r["doc_id"]: tuple(r) for r in got.collect()}
    assert len(found) == len(rows) and len(small) > 0.9 * len(rows)
    assert {i: found[i] for i in expected} == expected
    assert sum(r[1] > 0 for r in found.values()) > 5
