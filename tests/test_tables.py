"""Readers, gated writers and the whole study on the given tables."""

import os

import pytest
from pyspark.sql import functions as F

from cohortia.models.boost import fit_boost
from cohortia.models.params import BoostParams
from cohortia.models.predict import predict
from cohortia.operators import checks, explain
from cohortia.operators.correction import apply_correction
from cohortia.operators.eligibility import cohort_flow
from cohortia.plans.study import StudySettings, run_study
from cohortia.session import bucketed, checkpoint_dir, cut_lineage
from cohortia.sources import fixtures, tables


def test_round_trips(spark, tmp_path):
    folder = str(tmp_path)
    df = spark.createDataFrame([(1, "2020-01-01", 1.0)], "ID long, Visit_date string, HAQ_corrected double")
    df.write.parquet(f"{folder}/fixes.parquet")
    assert tables.load_correction(spark) is None
    fixes = tables.load_correction(spark, f"{folder}/fixes.parquet")
    assert fixes.columns[0] == "ID_original" and dict(fixes.dtypes)["Visit_date"] == "date"

    closed = tables.ExportConfig(folder)
    assert not tables.export(df, "rows", closed) and not os.path.exists(f"{folder}/rows.parquet")
    opened = tables.ExportConfig(folder, derived_outputs=True, model_artifacts=True, formats={"text": "csv"})
    assert tables.export(df, "visits", opened) and tables.export(df, "text", opened)
    assert tables.load_cohort(spark, folder, ["visits"])["visits"].count() == 1
    assert spark.read.option("header", True).csv(f"{folder}/text.csv").count() == 1

    flow = cohort_flow(df, {"known": F.col("ID").isNotNull()})
    assert tables.append_metrics("flow", flow, opened) and tables.append_metrics("again", flow, opened)
    written = spark.read.parquet(f"{folder}/metrics.parquet")
    assert written.where("metric = 'known.n_after' AND value = '1'").count() == 2
    assert not tables.append_metrics("flow", flow, tables.ExportConfig())


def test_model_round_trip(spark, tmp_path):
    rows = spark.range(60).select(
        F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"), (F.col("id") % 6).cast("double").alias("a")
    )
    params = BoostParams(max_depth=2)
    trees = fit_boost(rows, ["a"], "y", "row_id", params, 2)
    path = str(tmp_path / "model")
    assert not tables.save_model(trees, params.row(), path, tables.ExportConfig())
    assert tables.save_model(trees, params.row(), path, tables.ExportConfig(model_artifacts=True))
    loaded, settings = tables.load_model(spark, path)
    assert settings["eta"] == params.eta
    before = {r["row_id"]: r["p"] for r in predict(rows, trees, ["a"]).collect()}
    assert before == {r["row_id"]: r["p"] for r in predict(rows, loaded, ["a"]).collect()}


def test_a_rerun_leaves_one_copy_of_its_metrics(spark, tmp_path):
    folder = str(tmp_path)
    flow = spark.createDataFrame([("known", 5)], "step string, n long")
    first = tables.ExportConfig(folder, run="a")
    for stage in ("flow", "later", "flow"):
        tables.append_metrics(stage, flow, first)
    tables.append_metrics("flow", flow.withColumn("n", F.lit(7)), tables.ExportConfig(folder, run="b"))
    tables.append_metrics("flow", flow.withColumn("n", F.lit(6)), first)
    found = spark.read.parquet(f"{folder}/metrics.parquet").select("run", "stage", "metric", "value").collect()
    assert sorted(map(tuple, found)) == [("a", "flow", "known.n", "6"), ("a", "later", "known.n", "5"), ("b", "flow", "known.n", "7")]


def test_half_a_model_is_refused(spark, tmp_path):
    trees = spark.createDataFrame([(0, 0, 1, 0.5), (0, 1, 1, None)], "model_id int, tree int, node int, value double")
    opened = tables.ExportConfig(model_artifacts=True)
    path = str(tmp_path / "model")
    with pytest.raises(ValueError, match="no complete model"):
        tables.load_model(spark, path)
    trees.write.parquet(f"{path}/trees.parquet")
    with pytest.raises(ValueError, match="no complete model"):
        tables.load_model(spark, path)
    for _ in range(2):
        assert tables.save_model(trees, {"eta": 0.1}, path, opened)
        assert tables.load_model(spark, path)[0].count() == 2
    # A later attempt that got as far as the trees.
    trees.withColumn("value", F.lit(0.75)).write.mode("overwrite").parquet(f"{path}/trees.parquet")
    with pytest.raises(ValueError, match="do not belong together"):
        tables.load_model(spark, path)


def test_rows_are_compared_as_they_are_written(spark):
    facts = checks.row_facts(["id"])
    df = spark.createDataFrame([(1, "x"), (2, None), (None, "y")], "id long, `a.b` string")
    one = checks.watch(df, facts)
    assert one.table.count() == 3 and one.seen["n_rows"] == 3
    checks.same_rows(one, checks.watch(df.repartition(3).withColumn("more", F.lit(1)), facts))
    for other in (df.where("id = 1"), df.withColumn("id", F.col("id") + 1), df.limit(0)):
        with pytest.raises(ValueError, match="rows do not match"):
            checks.same_rows(one, checks.watch(other, facts))
    assert [tuple(r) for r in checks.key_repeats(df.unionByName(df.where("id IS NULL")), ["id"]).collect()] == [(None, 2)]


def test_repeated_corrections_are_reported(spark):
    baseline = spark.createDataFrame([(1, "a", 0.5), (2, "a", 0.7)], "ID_original long, Visit_date string, HAQ0 double")
    fixes = spark.createDataFrame([(1, "a", 1.0), (1, "a", 2.0), (2, "a", 3.0)], "ID_original long, Visit_date string, HAQ_corrected double")
    assert apply_correction(baseline, fixes).count() == 3
    once = apply_correction(baseline, fixes.where("HAQ_corrected > 1"), repeated="error")
    assert sorted(map(tuple, once.collect())) == [(1, "a", 2.0), (2, "a", 3.0)]
    with pytest.raises(Exception, match="repeated correction: 1, a"):
        apply_correction(baseline, fixes, repeated="error").collect()
    with pytest.raises(ValueError, match="repeated"):
        apply_correction(baseline, fixes, repeated="drop")


def test_bucketed_tables_meet_without_an_exchange(spark):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = bucketed(spark.range(500).select(F.col("id").alias("row.id"), F.lit(1).alias("x")).repartition(3), "row.id")
        right = bucketed(spark.range(250).select((F.col("id") * 2).alias("row.id"), F.col("id").alias("y")), "row.id")
        watched = checks.watch(left.where("x = 1"), checks.row_facts(["row.id"]), lambda df: bucketed(df, "row.id"))
        assert watched.seen["n_rows"] == 500
        for one in (left, watched.table):
            joined = one.join(right, ["row.id"])
            assert joined.count() == 250
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_cut_lineage_uses_the_checkpoint_folder(spark):
    folder = checkpoint_dir(spark)
    assert checkpoint_dir(spark) == folder
    cut = cut_lineage(spark.range(5).withColumn("x", F.col("id") + 1))
    assert cut.count() == 5 and "Scan ExistingRDD" in cut._jdf.queryExecution().toString()


@pytest.mark.parametrize("reduced", [False, True])
def test_study(spark, reduced, tmp_path):
    views = fixtures.Views(spark, "/root/testdata/sf0.01")
    baseline = views.baseline(drugs=True).withColumns(
        {"row_id": F.col("visit_id"), "BMI": F.lit(1.0), "smoker": F.col("visit_id") % 2 == 0}
    )
    small = (BoostParams(eta=0.3, max_depth=2), 2)
    settings = StudySettings(
        external_sites=fixtures.EXTERNAL_SITES,
        excluded_sites=fixtures.EXCLUDED_SITES,
        extraction_overrides=fixtures.EXTRACTION_OVERRIDES,
        cutoff_site=fixtures.CUTOFF_SITE,
        introduction_years=fixtures.INTRODUCTION_YEARS,
        drug_groups=fixtures.DRUG_GROUPS,
        encoded_columns=("treatment_group", "segment", "smoker"),
        excluded_columns=("ID", "ttt_course", "ID_ttt", "ID_original", "visit_id", "generic_name", "disease", "year",
                          "CDAI24_10", "afterJaki", "treatment_duration_calc",
                          *[f"treatment_{g}" for g in fixtures.DRUG_GROUPS]),
        base_variables=["HAQ0", "CDAI0", "segment"] if reduced else None,
        run_tuning=reduced,
        grid={"eta": [0.3], "max_depth": [1, 2], "nrounds": [2]},
        folds=2,
        initial=small,
        default=small,
        replicates=20,
        output=tables.ExportConfig(str(tmp_path), derived_outputs=reduced, model_artifacts=reduced),
    )
    tables_found = run_study(views.visits(), baseline, views.correction(), settings)
    flow = tables_found["cohort_flow"].orderBy("step_no").collect()
    scored = tables_found["scored"]
    assert flow[-1]["n_after"] >= scored.count() > 0
    assert {r["split"] for r in scored.select("split").distinct().collect()} == {"train", "test", "external"}
    assert tables_found["evaluation"].count() == 6 and tables_found["summary"].count() == 3
    names = {r["variable"] for r in tables_found["shap_high_score"].collect()}
    if reduced:
        assert names <= {"HAQ0", "CDAI0", *[n for n in names if n.startswith("segment.")]}
        assert tables_found["tuning"].count() == 2
    else:
        assert {"Weight", "treatment_group.G1", "smoker.true"} <= names
    assert not names & {"CDAI_response", "split", "row_id", "Code", "baseline_remission"}
    assert tables_found["shap_top_by_group"].where("variable LIKE 'treatment_group.%'").count() == 0
    for name in ("outcome", "baseline_remission", "missingness", "table_one_continuous", "table_one_categorical",
                 "sensitivity", "subgroups", "initial_evaluation", "initial_shap_top", "remission_group_counts",
                 "rows_without_site", "correction_count", "cardinality", "levels", "near_zero_variance", "roc",
                 "operating_points", "binarised_roc", "binarised_point", "shap_subset"):
        assert tables_found[name].count() > 0, name
    written = {p.name for p in tmp_path.iterdir()}
    assert ("summary.parquet" in written) == ("model" in written) == reduced
    assert spark.read.parquet(f"{tmp_path}/metrics.parquet").select("stage").distinct().count() == 4
    if reduced:
        trees, saved = tables.load_model(spark, f"{tmp_path}/model")
        assert trees.count() == tables_found["trees"].count() and saved["nrounds"] == 2
    with pytest.raises(ValueError, match="missing columns"):
        run_study(views.visits().drop("CDAI"), baseline, None, settings)
    assert explain.top_variables(tables_found["shap_high_score"].withColumnRenamed("mean_abs_shap", "value")).count() > 0
