"""Boosting, tuning and attributions against brute force, hand cases and invariants."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortia.models import tune as tuning
from cohortia.models.binning import bin_edges
from cohortia.models.boost import GRID_UNIT, Boosting, Fit, fit_boost, grow_subtree
from cohortia.models.params import GRID, BoostParams, param_grid
from cohortia.models.predict import collect_trees, predict
from cohortia.models.shap import attributions, expected_margin, margin_gap, shap_long, shap_scaled, shap_wide
from cohortia.operators import metrics

FEATURES = ["a", "b.x", "c"]


def table(spark, n=240, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = None if rng.random() < 0.15 else rng.randrange(12) / 2
        b = float("nan") if rng.random() < 0.1 else rng.random()
        c = float(rng.randrange(3))
        y = int((a or 4) + 3 * (0 if math.isnan(b) else b) + c + rng.gauss(0, 1) > 5.5)
        rows.append((i, y, a, b, c))
    return spark.createDataFrame(rows, "row_id long, y int, a double, `b.x` double, c double"), rows


def brute_trees(rows, edges, params, rounds):
    """Grow the same trees with plain loops over rows and cuts."""
    missing = [math.nan if v is None else v for r in rows for v in r[2:]]
    x = np.array(missing).reshape(len(rows), 3)
    y = np.array([r[1] for r in rows], float)
    margin = np.zeros(len(rows))
    trees = []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * GRID_UNIT) / GRID_UNIT, np.rint(p * (1 - p) * GRID_UNIT) / GRID_UNIT
        tree = {}

        def weight(members, g=g, h=h):
            return -params.eta * g[members].sum() / (h[members].sum() + params.reg_lambda)

        def score(members, g=g, h=h):
            return g[members].sum() ** 2 / (h[members].sum() + params.reg_lambda)

        def grow(node, members, depth, g=g, h=h, tree=tree, weight=weight, score=score):
            best = None
            if depth < params.max_depth:
                for f, name in enumerate(FEATURES):
                    for cut, default_left in itertools.product([*edges[name], math.inf], [False, True]):
                        value = x[members, f]
                        left = np.where(np.isnan(value), default_left, value < cut)
                        one, two = members[left], members[~left]
                        if not len(one) or not len(two):
                            continue
                        if min(h[one].sum(), h[two].sum()) < params.min_child_weight:
                            continue
                        gain = score(one) + score(two) - score(members)
                        if gain > 1e-6 and gain >= params.gamma and (best is None or gain > best[0] + 1e-9):
                            best = (gain, name, cut, default_left, one, two)
            if best is None:
                tree[node] = (None, None, weight(members))
                margin[members] += weight(members)
                return
            tree[node] = (best[1], best[2], None)
            grow(2 * node, best[4], depth + 1)
            grow(2 * node + 1, best[5], depth + 1)

        grow(1, np.arange(len(rows)), 0)
        trees.append(tree)
    return trees


@pytest.mark.parametrize(
    "params",
    [
        BoostParams(eta=0.3, max_depth=3),
        BoostParams(eta=0.1, max_depth=2, gamma=2.0, min_child_weight=6.0, reg_lambda=0.5),
    ],
)
def test_trees_equal_brute_force(spark, params):
    df, rows = table(spark)
    edges = bin_edges(df, FEATURES, "y", 64)
    assert edges["c"] == [0.5, 1.5] and len(edges["b.x"]) <= 63
    found = {}
    for row in fit_boost(df, FEATURES, "y", "row_id", params, 3).collect():
        found.setdefault(row["tree"], {})[row["node"]] = row
    for t, tree in enumerate(brute_trees(rows, edges, params, 3)):
        assert set(found[t]) == set(tree)
        for node, (name, cut, value) in tree.items():
            assert found[t][node]["feature"] == name
            if name:
                assert found[t][node]["split_value"] == cut
            else:
                assert found[t][node]["value"] == pytest.approx(value, abs=1e-9)


@pytest.mark.parametrize("params", [BoostParams(eta=0.3, max_depth=5, min_child_weight=0.3, subsample=0.8, colsample_bytree=0.7)])
def test_trees_do_not_depend_on_where_nodes_are_grown(spark, params):
    """All levels by all tasks with subtraction, all in one task, and mixtures of both, for several models at once."""
    df, _ = table(spark, 400)
    folded = df.withColumn("k", (F.col("row_id") % 2).cast("int"))
    fits = [Fit(0, params, 0), Fit(1, params, 1), Fit(2, BoostParams(eta=0.1, max_depth=2, gamma=0.5))]
    grown = []
    for grow_rows in (0, 25, 120, 1 << 17):
        job = Boosting(folded, FEATURES, "y", "row_id", fits, 5, "k", grow_rows=grow_rows)
        job.run(3)
        grown.append(sorted(map(tuple, job.tree_rows().collect()), key=lambda r: r[:3]))
        job.close()
    assert grown[0] == grown[1] == grown[2] == grown[3]
    assert max(row[2] for row in grown[0]) >= 16 and {row[0] for row in grown[0]} == {0, 1, 2}


def test_subtrees_equal_level_jobs_without_missing_values_or_gain():
    bins = np.array([[0, 3], [0, 3], [1, 3], [1, 3]], np.uint8)
    g, h = np.full(4, GRID_UNIT // 2), np.full(4, GRID_UNIT // 4)
    rows = grow_subtree(bins, g, h, 5, [2, 4], BoostParams(max_depth=6), 8)
    assert [(r["node"], r["feature"], r["g"]) for r in rows] == [(5, None, 2 * GRID_UNIT)]
    g = np.array([1, 1, -1, -1]) * (GRID_UNIT // 2)
    rows = grow_subtree(bins, g, h, 5, [2, 4], BoostParams(max_depth=3, min_child_weight=0.0), 8)
    assert [(r["node"], r["feature"], r["bin"], r["nl"], r["nr"]) for r in rows] == [(5, 2, 0, 2, 2)]
    assert grow_subtree(bins, 0 * g, 0 * h, 1, [2, 4], BoostParams(), 8) == []


def test_hand_case_with_missing_values(spark):
    """Eight rows, two of them missing, one split: the missing ones side with the ones they resemble."""
    rows = [(i, int(x is None or x > 2), x) for i, x in enumerate([1.0, 1.0, 2.0, 2.0, 3.0, 3.0, None, None])]
    df = spark.createDataFrame(rows, "row_id long, y int, a double")
    params = BoostParams(eta=1.0, max_depth=1, min_child_weight=0.0)
    nodes = {r["node"]: r for r in fit_boost(df, ["a"], "y", "row_id", params, 1).collect()}
    assert nodes[1]["split_value"] == 2.5 and nodes[1]["default_left"] is False
    # Gradients 4 x 0.5 left, 4 x -0.5 right, curvature 0.25 each, lambda 1.
    assert nodes[2]["value"] == pytest.approx(-2 / 2) and nodes[3]["value"] == pytest.approx(2 / 2)
    assert nodes[1]["gain"] == pytest.approx(4 / 2 + 4 / 2) and nodes[1]["cover"] == 2.0


def test_trees_do_not_depend_on_partitions_and_refresh(spark):
    df, _ = table(spark)
    params = BoostParams(eta=0.3, max_depth=3, subsample=0.7, colsample_bytree=0.7)
    grown = []
    for partitions, refresh in ((1, 10), (7, 10), (3, 2)):
        job = Boosting(df.repartition(partitions), FEATURES, "y", "row_id", [Fit(0, params)], 5, refresh=refresh)
        job.run(5)
        grown.append(sorted(map(tuple, job.tree_rows().collect()), key=lambda r: r[1:3]))
        job.close()
    assert grown[0] == grown[1] == grown[2]
    per_tree = {}
    for row in grown[0]:
        per_tree.setdefault(row[1], set()).add(row[3])
    assert all(len(names - {None}) <= 2 for names in per_tree.values())


def test_loss_falls_and_scores_agree(spark):
    df, _ = table(spark)
    params = BoostParams(eta=0.1, max_depth=2)
    trees = fit_boost(df, FEATURES, "y", "row_id", params, 6).cache()
    losses = []
    for rounds in range(7):
        scored = predict(df, trees.where(F.col("tree") < rounds), FEATURES, keep=["row_id", "y"])
        assert scored.columns == ["row_id", "y", "p"]
        losses.append(scored.agg(F.avg(-F.log(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p"))))).first()[0])
    assert losses == sorted(losses, reverse=True) and losses[0] == pytest.approx(math.log(2))


def brute_shapley(values, forest, feature_count):
    """Shapley values of the path-dependent value function by enumeration of coalitions."""

    def value(tree, node, members):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        if f in members:
            x = values[f]
            left = tree.default_left[node] if math.isnan(x) else x < tree.cut[node]
            return value(tree, 2 * node + (not left), members)
        sides = (2 * node, 2 * node + 1)
        return sum(tree.cover[s] * value(tree, s, members) for s in sides) / tree.cover[node]

    phi = np.zeros(feature_count)
    for tree in forest:
        for f in range(feature_count):
            others = [k for k in range(feature_count) if k != f]
            for size in range(feature_count):
                share = math.factorial(size) * math.factorial(feature_count - size - 1) / math.factorial(feature_count)
                for members in itertools.combinations(others, size):
                    phi[f] += share * (value(tree, 1, {*members, f}) - value(tree, 1, set(members)))
    return phi


def test_attributions(spark):
    df, rows = table(spark)
    trees = fit_boost(df, FEATURES, "y", "row_id", BoostParams(eta=0.3, max_depth=4, min_child_weight=0.5), 3).cache()
    forest = collect_trees(trees, FEATURES)
    x = np.array([[math.nan if v is None else v for v in r[2:]] for r in rows[:25]])
    exact = np.array([brute_shapley(row, forest, 3) for row in x])
    assert np.abs(attributions(x, forest) - exact).max() < 1e-12

    long = shap_long(df, trees, FEATURES)
    assert long.count() == 3 * len(rows)
    wide = shap_wide(predict(df, trees, FEATURES), trees, FEATURES, keep=["row_id", "b.x", "p"])
    assert wide.columns == ["row_id", "b.x", "p", "phi", "x"]
    gap = margin_gap(wide, expected_margin(forest, 0.5)).first()
    assert gap["n_rows"] == len(rows) and gap["max_gap"] < 1e-9
    scaled = shap_scaled(wide, FEATURES)
    assert scaled.agg(F.min("stdfvalue"), F.max("stdfvalue")).first()[:] == (0.0, 1.0)
    missing = long.where("variable = 'a' AND rfvalue IS NULL").count()
    assert missing == sum(r[2] is None for r in rows)


def test_grid_order():
    grid = param_grid(**GRID)
    assert len(grid) == 1458 and len({tuple(p.values()) for p in grid}) == 1458
    assert [p["eta"] for p in grid[:4]] == [0.01, 0.05, 0.1, 0.01] and grid[0]["nrounds"] == 50 == grid[485]["nrounds"]
    assert grid[486]["nrounds"] == 100 and grid[3]["max_depth"] == 6


def test_early_stopping_rule():
    one = tuning.Candidate(BoostParams(), 10)
    one.extend([0.5, 0.7, 0.7, 0.6, 0.9], patience=2)
    assert one.stopped and one.history == [0.5, 0.7, 0.7, 0.6] and one.best(50) == (2, 0.7) and one.best(1) == (1, 0.5)
    endless = tuning.Candidate(BoostParams(), 6)
    endless.extend([0.9, 0.5, 0.5, 0.5, 0.5, 0.6], patience=None)
    assert len(endless.history) == 6 and not endless.stopped and endless.best(6) == (1, 0.9)
    short = tuning.Candidate(BoostParams(), 3)
    short.extend([0.5, 0.6, 0.7, 0.8], patience=5)
    assert short.history == [0.5, 0.6, 0.7] and not short.stopped


def brute_edges(values, bins):
    """An edge between all of few values, else after each value that completes a share of the rows."""
    known = sorted(v for v in values if v is not None and not math.isnan(v))
    distinct = sorted(set(known))
    edges = set()
    for one, two in zip(distinct, distinct[1:]):
        upto, below = sum(v <= one for v in known), sum(v < one for v in known)
        if len(distinct) <= bins or upto * bins // len(known) > below * bins // len(known):
            edges.add((one + two) / 2)
    return sorted(edges)


@pytest.mark.parametrize("bins", [2, 16, 64, 255])
def test_edges_equal_brute_force(spark, bins):
    rng = random.Random(bins)
    kinds = [
        lambda: rng.choice([None, float("nan"), rng.gauss(0, 1), rng.gauss(0, 1e-300), -rng.expovariate(1e200)]),
        lambda: float(rng.randrange(bins)),
        lambda: float(rng.randrange(bins + 1) - 5),
        lambda: rng.choice([0.0, -0.0, 1.0]) if rng.random() < 0.9 else rng.random() / 1e9,
        lambda: 1 + rng.randrange(700) * 2.0**-52,
        lambda: None,
        lambda: rng.choice([float("inf"), -float("inf"), 3.0]),
        lambda: 7.0,
    ]
    rows = [tuple(kind() for kind in kinds) for _ in range(600)]
    names = [f"v.{i}" for i in range(len(kinds))]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` double" for n in names))
    for parts in (1, 5):
        found = bin_edges(df.repartition(parts), names, max_bins=bins)
        for i, name in enumerate(names):
            expected = brute_edges([r[i] for r in rows], bins)
            assert [str(e) for e in found[name]] == [str(e) for e in expected]


def test_edges_see_labelled_rows_only(spark):
    df, _ = table(spark)
    unlabelled = df.withColumn("y", F.when(F.col("row_id") % 2 == 0, F.col("y")))
    assert bin_edges(unlabelled, FEATURES, "y", 16) == bin_edges(df.where("row_id % 2 = 0"), FEATURES, "y", 16)
    assert bin_edges(df.limit(0), ["a"]) == {"a": []} and bin_edges(df, []) == {}
    for bins in (1, 256):
        with pytest.raises(ValueError, match="max_bins"):
            bin_edges(df, FEATURES, "y", bins)


def test_cells_are_sent_in_parts(spark, monkeypatch):
    from cohortia.models import quantiles

    df, _ = table(spark)
    whole = bin_edges(df, FEATURES, "y", 16)
    monkeypatch.setattr(quantiles, "MOST_CELLS", 3)
    assert bin_edges(df, FEATURES, "y", 16) == whole


def test_trees_with_most_bins(spark):
    df, _ = table(spark)
    edges = bin_edges(df, FEATURES, "y", 255)
    assert len(edges["b.x"]) > 150
    found = {r["node"]: r for r in fit_boost(df, FEATURES, "y", "row_id", BoostParams(max_depth=2), 1, max_bins=255).collect()}
    assert len(found) >= 3 and set(found) <= set(range(1, 8))


def test_early_stopping_must_be_positive_or_off(spark):
    df, _ = table(spark)
    grid = param_grid(
        eta=[0.3], max_depth=[1], gamma=[0.0], colsample_bytree=[1.0], min_child_weight=[1.0], subsample=[1.0], nrounds=[2]
    )
    with pytest.raises(ValueError, match="early_stop"):
        tuning.tune(df, FEATURES, "y", "row_id", grid, folds=2, early_stop=0)
    assert tuning.tune(df, FEATURES, "y", "row_id", grid, folds=2, early_stop=None).first()["rounds_run"] == 2


def test_tuning_equals_separate_fits(spark):
    df, _ = table(spark)
    grid = param_grid(
        eta=[0.3], max_depth=[1, 2], gamma=[0.0], colsample_bytree=[0.7], min_child_weight=[1.0], subsample=[0.8],
        nrounds=[2, 3],
    )
    results = tuning.tune(df, FEATURES, "y", "row_id", grid, folds=2, early_stop=2, seed=7)
    rows = {r["grid_id"]: r for r in results.collect()}
    assert len(rows) == 4 and rows[1]["rounds_run"] == 2

    from cohortia.operators.split import stratified_folds

    folded = stratified_folds(df, "y", "row_id", "7", 2, "k").cache()
    edges = bin_edges(folded, FEATURES, "y")
    params = BoostParams(eta=0.3, max_depth=2, colsample_bytree=0.7, subsample=0.8)
    best = []
    for rounds in (1, 2):
        areas = []
        for k in (0, 1):
            job = Boosting(folded.where(f"k <> {k}"), FEATURES, "y", "row_id", [Fit(0, params)], 7, edges=edges)
            job.run(rounds)
            scored = predict(folded.where(f"k = {k}"), job.tree_rows(), FEATURES)
            areas.append(metrics.auc(scored, direction="<").first()["auc"])
            job.close()
        best.append(sum(areas) / 2)
    assert rows[2]["test_auc_mean"] == pytest.approx(max(best), abs=1e-12)
    top = tuning.best_params(results).first()
    ordered = sorted(rows.values(), key=lambda r: (-r["test_auc_mean"], r["grid_id"]))
    assert top["grid_id"] == ordered[0]["grid_id"]
    params, rounds = tuning.chosen_params(results)
    assert rounds == top["nrounds"] and params.max_depth == top["max_depth"]
