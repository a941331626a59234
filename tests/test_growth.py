"""Plans and jobs that must not grow with the rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cohortia.models import boost
from cohortia.models.boost import Boosting, Fit, Sums
from cohortia.models.params import BoostParams
from cohortia.operators import explain


def test_attributions_meet_their_groups_without_a_broadcast(spark):
    rows = spark.range(40)
    cells = F.array(*[F.struct(F.lit(f"f{k}").alias("variable"), (F.col("id") * k % 7).cast("double").alias("value")) for k in (1, 2, 3)])
    shap = rows.select(F.col("id").alias("row_id"), F.inline(cells))
    groups = rows.select(F.col("id").alias("row_id"), F.when(F.col("id") % 5 != 0, F.col("id") % 2).cast("string").alias("treatment_group"))
    ranked = explain.top_by_group(shap, groups, n=2)
    found = {(r["treatment_group"], r["rank"]): (r["variable"], r["mean_abs_shap"]) for r in ranked.collect()}
    want = {}
    for g in (0, 1):
        means = {f"f{k}": sum(i * k % 7 for i in range(40) if i % 5 and i % 2 == g) / 16 for k in (1, 2, 3)}
        for rank, name in enumerate(sorted(means, key=lambda v: (-means[v], v))[:2], 1):
            want[str(g), rank] = (name, means[name])
    assert found == want
    assert "Broadcast" not in ranked._jdf.queryExecution().executedPlan().toString()


def training(spark, n=300):
    x = F.col("id")
    return spark.range(n).select(
        x.alias("row_id"), (x * 7 % 13 + x % 3 > 7).cast("int").alias("y"), (x * 7 % 13).cast("double").alias("a"),
        (x % 3).cast("double").alias("b.x"), F.when(x % 5 != 0, x * 11 % 17).cast("double").alias("c"), (x % 2).cast("int").alias("k"),
    )


def test_a_level_reads_the_rows_once(spark):
    """The histograms of the levels above are kept, not added up again from the rows at each level."""
    params = BoostParams(eta=0.3, max_depth=4, min_child_weight=0.1)
    job = Boosting(training(spark), ["a", "b.x", "c"], "y", "row_id", [Fit(0, params)], 5, grow_rows=0)
    tasks, levels, add_up = spark.sparkContext.accumulator(0), [], job._histograms

    def counted(growing, nodes):
        levels.append(nodes)
        found = add_up(growing, nodes)

        def tally(batches):
            tasks.add(1)
            yield from batches

        return found.mapInArrow(tally, found.schema)

    job._histograms = counted
    job.run(2)
    assert len(levels) >= 6
    assert tasks.value == len(levels) * job.rows.rdd.getNumPartitions()
    job.close()


def test_tasks_send_each_held_out_score_once(spark, monkeypatch):
    """Counts of equal scores are added up over the batches of a task, and stay right where they are sent in parts."""
    from cohortia.models import boost

    fits = [Fit(k, BoostParams(eta=0.3, max_depth=2, min_child_weight=0.1), k) for k in (0, 1)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        job = Boosting(training(spark), ["a", "b.x", "c"], "y", "row_id", fits, 5, "k")
        job.run(2)
        parts = job.held_out_parts().withColumn("task", F.spark_partition_id()).collect()
        keys = [(r["task"], r["model"], r["round"], r["score"]) for r in parts]
        assert len(keys) == len(set(keys))
        assert all(sum(r["pos"] + r["neg"] for r in parts if (r["model"], r["round"]) == (m, t)) == 150 for m in (0, 1) for t in (1, 2))
        whole = sorted(map(tuple, job.held_out_counts().collect()))
        monkeypatch.setattr(boost, "SEND_ROWS", 5)
        assert sorted(map(tuple, job.held_out_counts().collect())) == whole
        job.close()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_round_descends_one_earlier_tree(spark, monkeypatch):
    """Margins of a model grown alone are moved on each round; the jobs of a round descend the tree they grow, no others."""
    calls, descend = spark.sparkContext.accumulator(0), boost.descend

    def counted(bins, tree):
        calls.add(1)
        return descend(bins, tree)

    monkeypatch.setattr(boost, "descend", counted)
    job = Boosting(training(spark), ["a", "b.x", "c"], "y", "row_id", [Fit(0, BoostParams(eta=0.3, max_depth=2, min_child_weight=0.1))], 5, grow_rows=0)
    jobs, add_up = [], job._histograms
    job._histograms = lambda *nodes: jobs.append(nodes) or add_up(*nodes)
    job.run(5)
    blocks = job.rows.count()
    assert calls.value == blocks * (len(jobs) + 4)
    job.close()


def test_trees_do_not_depend_on_where_histograms_meet(spark, monkeypatch):
    """All by the driver, all in a shuffle, and the first levels here, the others there."""
    params, names = BoostParams(eta=0.3, max_depth=4, min_child_weight=0.1), ["a", "b.x", "c"]
    # What four tasks send for one node.
    part = 4 * 3 * 3 * 8 * 65
    grown = []
    for most in (1 << 20, 0, part):
        monkeypatch.setattr(boost, "GATHER_BYTES", most)
        job = Boosting(training(spark), names, "y", "row_id", [Fit(0, params)], 5, grow_rows=0)
        assert job.parts == job.rows.rdd.getNumPartitions() == 4
        job.run(2)
        grown.append(sorted(map(tuple, job.tree_rows().collect()), key=lambda r: r[:3]))
        job.close()
    assert grown[0] == grown[1] == grown[2] and max(row[2] for row in grown[0]) >= 8


def test_tasks_that_grow_nodes_get_like_shares(spark):
    """The nodes of each task are chosen by their rows, not by a hash."""
    job = Boosting(training(spark), ["a"], "y", "row_id", [Fit(0, BoostParams())], 5)
    sizes = {(0, node): rows for node, rows in zip(range(8, 17), (900, 100, 500, 400, 300, 300, 200, 250, 50), strict=True)}
    tasks, task_of = job._shares(sizes)
    assert tasks == spark.sparkContext.defaultParallelism == 4
    loads = [sum(rows for key, rows in sizes.items() if task_of[key] == task) for task in range(tasks)]
    assert sum(loads) == 3000 and max(loads) == 900
    assert job._shares({(0, 1): 300}) == (1, {(0, 1): 0})
    job.close()


def test_sums_of_curvature_and_rows_stay_apart():
    """Both are kept in one number, also where curvature is as large as can be on every row."""
    n = boost.COUNT_ROWS // 2
    sums, cell = Sums(1, 2), np.zeros(n, np.int64)
    for sign in (1, -1, 1, 1, 1):
        sums.add([cell], np.full(n, sign * boost.GRID_UNIT, np.int32), np.full(n, boost.GRID_UNIT // 4, np.int32))
    assert sums.cells().tolist() == [[[3 * n * boost.GRID_UNIT, 0]], [[5 * n * boost.GRID_UNIT // 4, 0]], [[5 * n, 0]]]
