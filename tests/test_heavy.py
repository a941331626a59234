"""Leading values by summaries against exact counts."""

import random
from collections import Counter

import numpy as np
import pytest

from cohortia.operators import heavy, profile

SCHEMA = "few long, `rare.x` double, wide long, spread string, one string, none double, zeros double, edge long, skew long"


def rows_of(seed, n=900):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append((
            rng.randrange(3),
            rng.choice([None, float("nan"), rng.random()]),
            i,
            rng.choice("abc") + str(rng.randrange(40)) if rng.random() < 0.5 else "top",
            "same" if i % 7 else None,
            None,
            rng.choice([0.0, -0.0]) if rng.random() < 0.98 else 1.0,
            0 if i % 20 else 1 + i // 20 % 2,
            0 if rng.random() < 0.97 else rng.randrange(60),
        ))
    return out


@pytest.mark.parametrize("counters", [2, 8, 256])
@pytest.mark.parametrize("partitions", [1, 6])
def test_leaders_and_their_bound(spark, counters, partitions):
    rows = rows_of(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(partitions)
    found = heavy.leading_values(df, df.columns, counters)
    for at, name in enumerate(df.columns):
        values = [r[at] + 0.0 if isinstance(r[at], float) else r[at] for r in rows]
        exact = Counter(v for v in values if v is not None and v == v)
        leaders = found[name]
        assert leaders.rows == len(rows) and leaders.known == sum(exact.values())
        assert len(leaders.counts) <= counters
        # What is counted is counted exactly, and nothing else is above the bound.
        left = Counter(exact.values())
        left.subtract(Counter(leaders.counts))
        assert min(left.values(), default=0) >= 0
        assert max((c for c, k in left.items() if k > 0), default=0) <= leaders.bound
        assert leaders.others == sum(c * k for c, k in left.items())


@pytest.mark.parametrize("counters", [1, 3, 256])
@pytest.mark.parametrize("seed", range(3))
def test_verdicts_equal_exact_counting(spark, counters, seed):
    df = spark.createDataFrame(rows_of(seed + 5), SCHEMA)
    exact = {r["variable"] for r in profile.near_zero_var(df, df.columns).where("nzv").collect()}
    assert profile.near_zero_names(df, df.columns, counters) == [c for c in df.columns if c in exact]
    assert {"one", "none", "zeros"} <= exact and not {"few", "wide"} & exact


def test_columns_that_the_leaders_settle_are_not_counted_out(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(2), SCHEMA)
    asked = []
    whole = profile.near_zero_var
    monkeypatch.setattr(profile, "near_zero_var", lambda df, columns, **more: asked.extend(columns) or whole(df, columns, **more))
    profile.near_zero_names(df, df.columns)
    assert not {"few", "one", "none", "zeros", "spread"} & set(asked)


def test_no_columns_and_no_rows(spark):
    df = spark.createDataFrame(rows_of(1, 5), SCHEMA)
    assert profile.near_zero_names(df, []) == []
    assert profile.near_zero_names(df.limit(0), ["few", "one"]) == ["few", "one"]
    assert heavy.near_zero(heavy.Leaders(1000, 1000, (10, 9), 20), 19, 10) is None
    assert heavy.near_zero(heavy.Leaders(1000, 1000, (950,), 3), 19, 10) is True
    assert heavy.near_zero(heavy.Leaders(1000, 1000, (900, 60), 3), 19, 10) is False


def test_shrinking_takes_the_same_from_all():
    values, counts = heavy.shrunk(np.array(list("abcd"), object), np.array([9, 5, 4, 1]), 2)
    assert values.tolist() == ["a", "b"] and counts.tolist() == [5, 1]
