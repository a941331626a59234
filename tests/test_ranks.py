"""Rank, split, ROC and bootstrap operators against brute force and their invariants."""

import hashlib
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from cohortia.operators import metrics, split
from cohortia.operators.bootstrap import auc_ci, auc_replicates
from cohortia.operators.evaluate import evaluate, summary_rows
from cohortia.operators.rank import hot_groups, numbered, numbered_in_parts, running_counts, score_counts, with_buckets


def visits(spark):
    rng = random.Random(1)
    rows = [(i, "hot" if i % 3 else f"k{i % 7}", rng.choice([None, 1, 2, 3, 4])) for i in range(600)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "id long, k string, day int"), rows


@pytest.mark.parametrize("hot_rows", [1, 50, 10**9])
def test_numbering_of_hot_and_ordinary_groups(spark, hot_rows, monkeypatch):
    from cohortia.operators import rank

    monkeypatch.setattr(rank, "BLOCK_IDS", 16)
    df, rows = visits(spark)
    found = {r["id"]: r["n"] for r in numbered(df, ["k"], "day", "id", "n", hot_rows).collect()}
    expected = {}
    for key in {k for _, k, _ in rows}:
        members = sorted((day is None, day or 0, i) for i, k, day in rows if k == key)
        expected |= {i: n for n, (_, _, i) in enumerate(members, 1)}
    assert found == expected


def test_hot_groups_are_the_large_ones(spark):
    df, _ = visits(spark)
    assert [r["k"] for r in hot_groups(df, ["k"], 300).collect()] == ["hot"]


def scored(spark, n=400, seed=2, levels=25):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.4)
        rows.append((i, "a" if i % 3 else "b", y, round((rng.random() + 0.4 * y) * levels) / levels))
    return spark.createDataFrame(rows, "row_id long, g string, y int, p double"), rows


def brute_auc(rows):
    pos, neg = [r[3] for r in rows if r[2] == 1], [r[3] for r in rows if r[2] == 0]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("parts", [None, 1, 16])
@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_running_counts_across_buckets(spark, parts, partitions):
    df, rows = scored(spark)
    counts = score_counts(df.repartition(partitions), "y", "p", ["g"])
    bucketed = with_buckets(counts, parts)
    if parts == 16:
        assert bucketed.select("bucket").distinct().count() > 3
    ranked = running_counts(bucketed, ["g"])
    for row in ranked.collect():
        below = [r for r in rows if r[1] == row["g"] and r[3] <= row["score"]]
        assert row["cum_pos"] == sum(r[2] for r in below) and row["cum_neg"] == sum(1 - r[2] for r in below)
        earlier = [r[3] for r in below if r[3] < row["score"]]
        assert row["prev_score"] == (max(earlier) if earlier else None)
    areas = {r["g"]: r["auc"] for r in metrics.auc_of(ranked, ["g"], "<").collect()}
    for g in "ab":
        assert areas[g] == pytest.approx(brute_auc([r for r in rows if r[1] == g]), abs=1e-12)


def test_auc_directions_and_maps(spark):
    df, rows = scored(spark)
    area = brute_auc(rows)
    assert metrics.auc(df, direction="<").first()["auc"] == pytest.approx(area)
    assert metrics.auc(df, direction=">").first()["auc"] == pytest.approx(1 - area)
    squeezed = df.withColumn("p", F.exp(F.col("p") * 3) - 7)
    assert metrics.auc(squeezed, direction="<").first()["auc"] == pytest.approx(area)
    turned = df.withColumn("p", -F.col("p"))
    assert metrics.auc(turned, direction="<").first()["auc"] == pytest.approx(1 - area)
    auto = metrics.auc(turned).first()
    assert auto["direction"] == ">" and auto["auc"] == pytest.approx(area)
    one_class = metrics.auc(df.where("y = 1")).first()
    assert one_class["auc"] is None
    assert metrics.auc(df.where("y = 1"), direction="<").first()["auc"] is None


def test_roc_and_youden(spark):
    df = spark.createDataFrame(
        [(1, 0.9), (1, 0.6), (0, 0.6), (0, 0.4), (1, 0.4), (0, 0.1), (None, 0.2), (1, None)], "y int, p double"
    )
    roc = metrics.roc_points(df).orderBy("threshold").collect()
    assert [(r["threshold"], r["tp"], r["fp"]) for r in roc] == [
        (-math.inf, 3, 3), (0.25, 3, 2), (0.5, 2, 1), (0.75, 1, 0), (math.inf, 0, 0)
    ]
    points = metrics.roc_points(df)
    best = metrics.youden_threshold(points).first()
    assert (best["threshold"], best["n_best"]) == (0.25, 3)
    assert {r["threshold"] for r in metrics.youden_ties(points).collect()} == {0.25, 0.5, 0.75}
    assert metrics.nearest_point(points, "threshold", 0.62).first()["threshold"] == 0.5
    assert metrics.nearest_point(points, "fpr", 0.5).first()["threshold"] == 0.25
    assert metrics.exact_point(points, 0.75).first()["tp"] == 1
    down = metrics.roc_points(df, direction=">").where("threshold = 0.25").first()
    assert (down["tp"], down["fp"]) == (0, 1)


def test_cells_always_have_four_parts(spark):
    df = spark.createDataFrame([(1, 0.2), (0, 0.1), (0, 0.5)], "y int, p double")
    cells = metrics.confusion(metrics.classify(df, 0.5))
    row = metrics.class_metrics(cells).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (0, 0, 1, 2)
    assert row["ppv"] is None and row["npv"] == pytest.approx(2 / 3) and row["specificity"] == 1.0
    assert row["f1_neg"] == pytest.approx(2 * (2 / 3) / (2 / 3 + 1)) and row["kappa"] == 0.0


def test_subgroups(spark):
    df, rows = scored(spark)
    grouped = df.withColumn("grp", F.when(F.col("row_id") % 5 != 0, F.concat(F.lit("q"), F.col("row_id") % 5)))
    grouped = grouped.where("NOT (grp <=> 'q4' AND y = 1)")
    found = {r["grp"]: r for r in metrics.subgroup_metrics(grouped, 0.6, "grp").collect()}
    assert set(found) == {"q1", "q2", "q3", "q4"} and found["q4"]["auc"] is None and found["q4"]["sensitivity"] is None
    one = [r for r in rows if r[0] % 5 == 1]
    assert found["q1"]["n"] == len(one)
    tp, fn = (sum(r[2] == 1 and (r[3] > 0.6) == up for r in one) for up in (True, False))
    assert found["q1"]["sensitivity"] == pytest.approx(tp / (tp + fn))


@pytest.mark.parametrize("partitions", [1, 7])
def test_split_is_exact(spark, partitions):
    rows = [(i, i % 3 == 0, None if i % 50 == 49 else f"S{i % 10}") for i in range(1003)]
    df = spark.createDataFrame(rows, "row_id long, late boolean, site string").repartition(partitions)
    df = df.withColumn("y", F.col("late").cast("int"))
    hold_out = split.HoldOut("site", ["S1"])
    found = {r["row_id"]: (r["y"], r["split"]) for r in split.assign_split(df, "y", "row_id", "s", hold_out).collect()}
    for y in (0, 1):
        inside = [i for i, late, site in rows if late == y and site not in (None, "S1")]
        ordered = sorted(inside, key=lambda i: (hashlib.md5(f"s/{i}".encode()).hexdigest(), i))
        train = set(ordered[: math.ceil(0.8 * len(inside))])
        assert all(found[i] == (y, "train" if i in train else "test") for i in inside)
    assert all(found[i][1] == "external" for i, _, site in rows if site == "S1")
    assert not any(site is None and i in found for i, _, site in rows)
    assert split.unassigned_rows(df, "site").first()[0] == sum(site is None for *_, site in rows)


def test_folds_are_level(spark):
    df = spark.range(103).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("y"))
    counts = split.stratified_folds(df, "y", "row_id", "s", 5).groupBy("y", "fold").count().collect()
    for y, total in ((1, 26), (0, 77)):
        sizes = [r["count"] for r in counts if r["y"] == y]
        assert len(sizes) == 5 and sum(sizes) == total and max(sizes) - min(sizes) <= 1


def test_bootstrap(spark):
    df, rows = scored(spark, 300)
    whole = {(r["g"], r["rep"]): r["auc"] for r in auc_replicates(df, by=["g"], reps=120).collect()}
    assert len(whole) == 240
    again = {(r["g"], r["rep"]): r["auc"] for r in auc_replicates(df.repartition(5), by=["g"], reps=120).collect()}
    assert whole == again
    parts = {(r["g"], r["rep"]): r["auc"] for r in auc_replicates(df, by=["g"], reps=120, bucket_scores=4).collect()}
    for g in "ab":
        area = brute_auc([r for r in rows if r[1] == g])
        for found in (whole, parts):
            values = [v for (group, _), v in found.items() if group == g]
            mean = sum(values) / len(values)
            spread = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
            assert abs(mean - area) < 4 * spread / math.sqrt(len(values)) + 1e-3
            assert 0.01 < spread < 0.1
    interval = auc_ci(df, by=["g"], reps=120).collect()
    assert all(r["ci_lower"] <= r["ci_median"] <= r["ci_upper"] for r in interval)
    ungrouped = auc_ci(df, by=[], reps=20).collect()
    assert len(ungrouped) == 1
    assert auc_ci(df.where("y = 1"), by=["g"], reps=20).collect() == []


def exact_law(counts):
    """Probability of each bootstrap AUC, by enumeration of both classes' draws."""
    n_pos, n_neg = sum(p for _, p, _ in counts), sum(n for _, _, n in counts)

    def draws(weights):
        total = sum(weights)
        out = {}
        for choice in itertools.product(range(len(weights)), repeat=total):
            got = tuple(choice.count(i) for i in range(len(weights)))
            out[got] = out.get(got, 0) + math.prod(weights[i] / total for i in choice)
        return out

    law = {}
    for pos, one in draws([p for _, p, _ in counts]).items():
        for neg, two in draws([n for _, _, n in counts]).items():
            wins = sum(neg[i] * (pos[i] / 2 + sum(pos[i + 1 :])) for i in range(len(counts)))
            area = round(wins / n_pos / n_neg, 9)
            law[area] = law.get(area, 0) + one * two
    return law


@pytest.mark.parametrize(("bucket_scores", "fanout"), [(100, 256), (1, 2), (2, 3), (1, 256)])
def test_bootstrap_has_the_law_of_a_whole_draw(spark, bucket_scores, fanout):
    """Whatever the tree, replicates follow the exact law, and the interval is the law's."""
    counts = [(0.1, 0, 2), (0.2, 1, 0), (0.4, 1, 1), (0.7, 2, 1), (0.9, 1, 0)]
    rows = [(y, s) for s, pos, neg in counts for y in [1] * pos + [0] * neg]
    reps = 4000
    found = auc_replicates(spark.createDataFrame(rows, "y int, p double"), by=[], reps=reps, bucket_scores=bucket_scores, fanout=fanout)
    areas = sorted(round(r["auc"], 9) for r in found.collect())
    law = exact_law(counts)
    assert len(areas) == reps and set(areas) <= set(law) and sum(law.values()) == pytest.approx(1)
    chi = sum((areas.count(a) - reps * p) ** 2 / (reps * p) for a, p in law.items() if reps * p >= 5)
    kinds = sum(reps * p >= 5 for p in law.values())
    assert chi < kinds + 5 * math.sqrt(2 * kinds)
    for share in (0.025, 0.975):
        # The exact quantile lies between those a little to both sides.
        low, high = areas[int((share - 0.012) * reps)], areas[int((share + 0.012) * reps) - 1]
        total, exact = 0.0, None
        for area in sorted(law):
            total += law[area]
            if exact is None and total >= share:
                exact = area
        assert low <= exact <= high


def test_evaluation_bundle(spark):
    df, rows = scored(spark)
    df = df.withColumn("split", F.when(F.col("g") == "a", "train").otherwise("test"))
    table = {(r["split"], r["at"]): r for r in evaluate(df, reps=30).collect()}
    assert len(table) == 4
    threshold = table["train", "trained"]["threshold"]
    assert table["test", "trained"]["threshold"] == threshold
    inside = [r for r in rows if r[1] == "b"]
    assert table["test", "trained"]["tp"] == sum(r[2] == 1 and r[3] > threshold for r in inside)
    assert table["test", "fixed"]["fp"] == sum(r[2] == 0 and r[3] > 0.5 for r in inside)
    text = {r["split"]: r for r in summary_rows(evaluate(df, reps=30)).collect()}
    assert " to " in text["test"]["auc"] and len(text["test"]["tpr"]) == 5


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_numbers_across_range_parts(spark, parts):
    rows = [(i, None if i % 11 == 0 else i * 7 % 40, "ab"[i % 2] if i % 5 else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, size long, g string").repartition(7)
    for by in ([], ["g"]):
        found = numbered_in_parts(df, by, ["size", "id"], "n", parts).collect()
        for g in ({None, "a", "b"} if by else {0}):
            own = [r for r in found if not by or r["g"] == g]
            own.sort(key=lambda r: (r["size"] is not None, r["size"] or 0, r["id"]))
            assert [r["n"] for r in own] == list(range(1, len(own) + 1)) and own
