"""Exact top-k search and sharding against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm.sharding import shard
from cohortia.llm.topk import search, threshold_search

from llm_helpers import corpus


def brute(rows, k, every):
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in {i for i, _ in whole if i % every == 0}:
        vector = next(v for i, v in whole if i == q)
        scored = [(-sum(a * b for a, b in zip(vector, v)), i) for i, v in whole if i != q and len(v) == len(vector)]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (40, 3)])
def test_search_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(0, 0.2, 6).tolist()) for i in range(150)]
    rows += [(200 + i, rows[i][1]) for i in range(20)]
    rows += [(300, None), (301, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6)]
    rows += [(None, [0.5] * 6), (310, [0.5, 0.5]), (320, []), (330, [0.0] * 6), (340, [0.25, -0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit(9)).withColumn("dims", F.lit("x"))
    got = search(df, F.col("vec_id") % 10 == 0, k=5, rows_per_block=blocks[0], queries_per_block=blocks[1])
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5, 10)


def test_search_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert search(df, F.col("vec_id") % 10 == 0).count() == 0
    alone = spark.createDataFrame([(10, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert search(alone, F.col("vec_id") % 10 == 0).count() == 0


def test_threshold_ends_early_and_keeps_ties():
    """A few long rows among many short ones: the bound ends the walk, and ties come by id."""
    rows = np.ones((5000, 4), np.int64)
    rows[:3] = 50
    rows[3:9] = 40
    ids = np.arange(5000)[::-1].copy()
    q, r, score = threshold_search(np.array([[1, 1, 1, 1]]), np.array([-1]), rows, ids, 5)
    assert score.tolist() == [200] * 3 + [160] * 2
    assert ids[r].tolist() == [4997, 4998, 4999, 4991, 4992]


def test_large_components_stay_exact():
    rows = np.array([[2**30, 1], [2**30, 2], [-(2**30), 3]], np.int64)
    _, r, score = threshold_search(rows[:1], np.array([0]), rows, np.arange(3), 2)
    assert score.tolist() == [2**60 + 2, -(2**60) + 3] and r.tolist() == [1, 2]


def test_shards_split_only_where_too_large(spark, docs_of):
    rows = corpus() + [(5000, "z" * 9000)] * 2
    limit = 2000
    got = shard(docs_of(rows, bits="clash", cell=1, id="x"), limit).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        assert len(r["shard"]) == r["depth"]
        size[r["shard"]] = size.get(r["shard"], 0) + r["n_bytes"]
    for r in got:
        assert size[r["shard"]] == r["shard_bytes"] and (r["shard_bytes"] <= limit or r["depth"] == 60)
    # No shard stands under another, and two brothers would not fit together.
    for s in size:
        assert not any(s != t and t.startswith(s) for t in size)
        if s:
            assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > limit
    assert shard(docs_of([]), limit).count() == 0
    assert {r["shard"] for r in shard(docs_of([(1, None), (2, "abc")]), limit).collect()} == {""}
