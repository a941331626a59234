"""Near-duplicate vectors against all pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.llm import cosine
from cohortia.llm.cosine import Cuts, Forest, links_of, near_vectors, unit
from cohortia.llm.queries import REGISTRY, SQL

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, threshold):
    """One row per given row; rows that share an id are one vertex."""
    whole = {}
    for at, (i, v, label) in enumerate(rows):
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            whole[at] = unit(np.array([v]))[0]
    parent = {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = dict.fromkeys(range(len(rows)), 0)
    for a, x in whole.items():
        for b, y in whole.items():
            if a != b and rows[a][2] == rows[b][2] and len(x) == len(y) and float(x @ y) >= threshold:
                n[a] += 1
                p, q = find(rows[a][0]), find(rows[b][0])
                parent[max(p, q)] = min(p, q)
    out = []
    for at, (i, _, _) in enumerate(rows):
        component = find(i) if at in whole else i
        out.append((i, n[at], component, i is None or component == i))
    return sorted(out, key=str)


def planted(seed=1, dims=12, n=260):
    """Random vectors, copies, near copies around the threshold, chains, and the cases that take no part."""
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (n, dims)) * np.geomspace(2, 0.2, dims)
    rows = [(i, base[i].tolist(), int(rng.integers(0, 3))) for i in range(n)]
    for i in range(n, n + 120):
        _, v, label = rows[int(rng.integers(0, len(rows)))]
        x = np.array(v)
        noise = rng.normal(0, 1, dims)
        noise *= np.linalg.norm(x) / np.linalg.norm(noise) * rng.choice([0.0, 0.05, 0.15, 0.2, 0.21, 0.25])
        rows.append((i, ((x + noise) * rng.choice([1.0, 3.0])).tolist(), label if rng.random() < 0.9 else None))
    rows += [(900 + i, rows[5][1], 1) for i in range(12)]
    rows += [(950, None, 1), (951, [], 1), (952, [0.0] * dims, 1), (953, [float("nan")] * dims, 1), (954, [None] * dims, 1)]
    rows += [(955, [float("inf")] + [0.0] * (dims - 1), 1), (956, rows[0][1][:3], rows[0][2]), (957, rows[0][1][:3], rows[0][2])]
    rows += [(None, rows[5][1], 1), (None, None, None), rows[7], rows[7], (8, rows[20][1], rows[20][2])]
    rows += [(960, [-x for x in rows[3][1]], rows[3][2]), (961, [1e300] * dims, 2), (962, [1e-310] * dims, 2), (963, [-0.0, 1.0], 2), (964, [0.0, 1.0], 2)]
    return rows


@pytest.mark.parametrize("tiles", [(512, 4096, 65_536), (8, 16, 40), (8, 8, 400)])
def test_equal_to_all_pairs(spark, monkeypatch, tiles):
    monkeypatch.setattr(cosine, "LEAST_TILE", tiles[0])
    monkeypatch.setattr(cosine, "MOST_TILE", tiles[1])
    monkeypatch.setattr(cosine, "TREE_ROWS", tiles[2])
    monkeypatch.setattr(cosine, "LEAST_ROWS", 4)
    rows = planted()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit(1), "key": F.lit("k"), "n": F.lit(2), "cell": F.lit(0)})
    got = near_vectors(df, threshold=0.98)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows, 0.98)


def test_one_label_of_copies_and_a_dense_group(spark):
    """Most rows are copies of one vector; around it lie others that all link with each other."""
    rng = np.random.default_rng(2)
    centre = rng.normal(0, 1, 64)
    rows = [(i, centre.tolist(), 1) for i in range(3000)]
    rows += [(3000 + i, (centre + rng.normal(0, 0.01, 64)).tolist(), 1) for i in range(200)]
    got = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r["n_links"] for r in got} == {3199} and {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_nothing_from_nothing(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    alone = near_vectors(spark.createDataFrame([(4, [1.0, 2.0], 1), (5, None, None)], SCHEMA))
    assert sorted(tuple(r) for r in alone.collect()) == [(4, 0, 4, True), (5, 0, 5, True)]


@pytest.mark.parametrize("same", [False, True])
def test_pairs_stop_early_and_stay_whole(same):
    rng = np.random.default_rng(3)
    a = unit(rng.normal(0, 1, (300, 40)))
    b = a if same else unit(np.vstack((a[:50] + rng.normal(0, 0.02, (50, 40)), rng.normal(0, 1, (200, 40)))))
    if same:
        a[200:] = unit(a[:100] + rng.normal(0, 0.02, (100, 40)))
    axes = np.linalg.eigh(a.T @ a)[1][:, ::-1]
    got = sorted((i, j) for x, y in links_of(a, b, axes, 0.98, same) for i, j in zip(x.tolist(), y.tolist()))
    near = a @ b.T >= 0.98
    assert got == [(i, j) for i, j in zip(*np.nonzero(near)) if not same or j > i] and got


def test_every_near_pair_meets_once_in_a_cell():
    rng = np.random.default_rng(4)
    points = rng.uniform(-1, 1, (2000, 3))
    tree = Cuts.fit(points[:500], 2000, 50, 0.2)
    assert tree.cells > 8
    row, cell, home = tree.deal(points, 0.2)
    assert sorted(row[home].tolist()) == list(range(2000))
    met = {}
    for c in range(tree.cells):
        mine, guests = row[(cell == c) & home], row[(cell == c) & ~home]
        for i in mine.tolist():
            for j in mine.tolist() + guests.tolist():
                if i != j:
                    met[frozenset((i, j))] = met.get(frozenset((i, j)), set()) | {c}
    distance = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    near = {frozenset((i, j)) for i, j in zip(*np.nonzero(distance <= 0.2)) if i < j}
    assert near <= set(met) and all(len(c) == 1 for c in met.values())
    assert len(met) < 2000 * 1999 / 6


def test_forest_spans():
    f = Forest(6)
    f.join(np.array([0, 1, 0, 3]), np.array([1, 2, 2, 4]))
    f.join(np.array([2]), np.array([3]))
    assert len(f.edges) == 4 and len({f.find(i) for i in range(5)}) == 1 and f.find(5) == 5


def test_query_equals_sql(spark, folder):
    found = REGISTRY["op12_near_vectors"](spark, folder)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    answer = connection.execute(f"SELECT {', '.join(found.columns)} FROM ({SQL['op12_near_vectors']})").fetchall()
    assert sorted(tuple(r) for r in found.collect()) == sorted(answer)
