"""Missing-data rules, calendar rules and corrections on small literal tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortia.functions.nulls import add_months_strict, capped, flag, is_in, not_in
from cohortia.operators import correction as corr
from cohortia.operators import eligibility as elig
from cohortia.operators import encode, profile, visits


def day(text):
    return dt.date.fromisoformat(text) if text else None


def test_exclusion_keeps_missing(spark):
    df = spark.createDataFrame([("DE",), ("X",), (None,)], "code string")
    assert {r[0] for r in df.where(not_in(F.col("code"), ["DE"])).collect()} == {"X", None}
    assert [r[0] for r in df.select(is_in(F.col("code"), ["DE"])).collect()] == [True, False, False]


def test_cap_and_flag_keep_missing(spark):
    df = spark.createDataFrame([(3.0,), (1.0,), (None,)], "x double")
    assert [r[0] for r in df.select(capped(F.col("x"), 2.0)).collect()] == [2.0, 1.0, None]
    assert [r[0] for r in df.select(flag(F.col("x") <= 2)).collect()] == [0, 1, None]


def test_strict_months(spark):
    df = spark.createDataFrame([(day("2020-08-31"),), (day("2020-02-29"),), (day("2020-01-15"),)], "d date")
    six = [r[0] for r in df.select(add_months_strict(F.col("d"), 6)).collect()]
    assert six == [None, day("2020-08-29"), day("2020-07-15")]
    two_years = [r[0] for r in df.select(add_months_strict(F.col("d"), 24)).collect()]
    assert two_years == [day("2022-08-31"), None, day("2022-01-15")]
    clamped = [r[0] for r in df.select(add_months_strict(F.col("d"), 6, clamp=True)).collect()]
    assert clamped[0] == day("2021-02-28")


VISITS = "visit_id long, ID long, ttt_course string, Visit_date date, ttt_startDate date, CDAI double"


def test_outcome_window_edges(spark):
    start = day("2020-01-10")
    rows = [
        (1, 1, "a", start, start, 1.0),
        (2, 1, "a", day("2020-07-10"), start, 2.8),
        (3, 2, "a", start, start, 9.0),
        (4, 2, "a", day("2022-01-10"), start, 2.81),
        (5, 3, "a", start, start, 9.0),
        (6, 3, "a", day("2022-01-11"), start, 1.0),
        (7, 4, "a", day("2020-08-01"), start, 1.0),
        (8, 5, "a", start, start, 9.0),
        (9, 5, "a", day("2020-03-01"), start, 1.0),
        (10, 5, "a", day("2020-09-01"), start, float("nan")),
        (11, None, "a", start, start, 9.0),
        (12, None, "a", day("2020-09-01"), start, 1.0),
    ]
    df = spark.createDataFrame(rows, VISITS)
    found = {r["ID"]: r["has_remission_cdai"] for r in visits.outcome_in_window(df).collect()}
    # Course 4's only visit in the window is its first one, course 5's has no score.
    assert found == {1: 1, 2: 0, None: 1}
    groups = {r["ID"]: r["remission_group"] for r in visits.remission_groups(df).collect()}
    assert groups == {1: "Late only", 2: "Never", 5: "Early only", None: "Late only"}
    base = spark.createDataFrame([(1, "a"), (None, "a"), (9, "a")], "ID long, ttt_course string")
    attached = visits.attach_outcome(base, visits.outcome_in_window(df))
    assert {r["ID"] for r in attached.collect()} == {1, None}


def test_first_visit_leaves_early_window_too(spark):
    start = day("2020-01-10")
    rows = [(1, 1, "a", day("2020-02-01"), start, 1.0), (2, 1, "a", day("2020-02-01"), start, 5.0)]
    df = spark.createDataFrame(rows, VISITS)
    row = visits.remission_groups(df).first()
    assert (row["early_remission"], row["remission_group"]) == (0, "Never")
    assert [r["visit_id"] for r in visits.early_visits(df).collect()] == [2]


def test_correction(spark):
    base = spark.createDataFrame(
        [(1, 10, "CH", 1.0), (2, None, "CH", 2.0), (3, 30, "CH", None), (4, 40, "X", 4.0)],
        "visit_id long, ID_original long, Code string, HAQ0 double",
    ).withColumn("Visit_date", F.lit("2020-01-01").cast("date"))
    fixes = spark.createDataFrame(
        [(10, 1.5, 1), (None, 2.5, 1), (30, 3.5, None), (40, None, 2)],
        "ID_original long, HAQ_corrected double, pair_id long",
    ).withColumn("Visit_date", F.lit("2020-01-01").cast("date"))
    fixed = corr.apply_correction(base, fixes, keep_original=True)
    assert {r["visit_id"]: r["HAQ0"] for r in fixed.collect()} == {1: 1.5, 2: 2.5, 3: 3.5, 4: 4.0}
    # The value that was missing before does not count as replaced.
    assert corr.correction_count(fixed, "CH").first()[0] == 2
    assert corr.apply_correction(base, None).columns == base.columns
    assert corr.dedup_baseline(base, None) is base
    doubled = corr.apply_correction(base, fixes.unionByName(fixes))
    assert doubled.count() == 8


def test_duplicate_pairs(spark):
    fixes = spark.createDataFrame(
        [(1, 7), (2, 7), (2, 7), (2, 8), (3, 8), (4, None)], "ID_original long, pair_id long"
    )
    assert {(r["pair_id"], r["n"]) for r in corr.pair_audit(fixes).collect()} == {(7, 2), (8, 2)}
    # Patient 2 loses pair 7 but is the lowest of pair 8 and stays.
    assert [r[0] for r in corr.ids_to_drop(fixes).collect()] == [3]
    base = spark.createDataFrame([(1,), (3,), (None,)], "ID_original long")
    assert {r[0] for r in corr.dedup_baseline(base, fixes).collect()} == {1, None}


def test_after_introduction_is_three_valued(spark):
    rows = [("A", 2015), ("A", 2014), ("B", 2030), (None, 2016), (None, 2010), ("A", None), ("B", None), (None, None)]
    df = spark.createDataFrame(rows, "Code string, year int")
    found = [r["afterJaki"] for r in elig.after_introduction(df, {"A": 2015, "C": 2013}).collect()]
    assert found == [1, 0, 0, None, 0, None, 0, None]


def test_groups_and_trimming(spark):
    df = spark.createDataFrame([("x",), ("x ",), ("y",), (None,)], "generic_name string")
    groups = {"G1": ["x "], "G2": ["y", "x"]}
    assert [r["treatment_group"] for r in elig.map_groups(df, groups).collect()] == ["G1", "G1", "G2", None]
    raw = elig.map_groups(df, groups, trim=False).collect()
    assert [r["treatment_group"] for r in raw] == ["G2", "G1", "G2", None]
    assert [r["treatment_G1"] for r in raw] == [False, True, False, False]


def test_duration_and_cutoff(spark):
    schema = "Code string, ttt_startDate date, ttt_stopDate date, lostFUDate date, extraction_date date"
    rows = [
        ("A", day("2020-01-01"), day("2021-01-01"), day("2020-02-01"), day("2025-01-01")),
        ("A", day("2020-01-01"), None, day("2020-02-01"), day("2025-01-01")),
        ("A", day("2020-01-01"), None, None, day("2025-01-01")),
        ("A", day("2020-01-01"), None, None, None),
        ("NO", None, None, None, None),
        ("NO", day("2022-01-01"), None, None, None),
        (None, day("2022-01-01"), None, None, None),
    ]
    df = elig.override_by_site(spark.createDataFrame(rows, schema), "end", "extraction_date", {"NO": "2021-01-01"})
    kept = elig.site_cutoff_filter(df, "NO", "ttt_startDate", "end")
    assert [r["Code"] for r in kept.collect()] == ["A", "A", "A", "A", None]
    years = [r[0] for r in elig.treatment_duration(kept, "end").select("treatment_duration_calc").collect()]
    assert years == [pytest.approx(366 / 365.25), pytest.approx(31 / 365.25), 2.0, None, None]


def test_cohort_flow_counts_in_order(spark):
    df = spark.createDataFrame([(1, None), (2, True), (3, False), (4, True)], "x int, ok boolean")
    rows = elig.cohort_flow(df, {"ok": F.col("ok"), "small": F.col("x") < 4}).collect()
    assert [(r["n_before"], r["n_removed"], r["n_after"]) for r in rows] == [(4, 2, 2), (2, 1, 1)]


def test_near_zero_variance_cuts(spark):
    rows = [(0 if i % 20 == 0 else 1, 0 if i % 21 == 0 else 1, 5.0, None, float(i)) for i in range(420)]
    df = spark.createDataFrame(rows, "at int, above int, one double, nothing double, many double")
    found = {r["variable"]: r for r in profile.near_zero_var(df, df.columns).collect()}
    assert found["at"]["freq_ratio"] == 19 and not found["at"]["nzv"]
    assert found["above"]["freq_ratio"] == 20 and found["above"]["nzv"]
    assert found["one"]["zero_var"] and found["nothing"]["zero_var"] and not found["many"]["nzv"]
    assert sorted(profile.near_zero_names(df, df.columns)) == ["above", "nothing", "one"]


def test_cardinality_counts_null(spark):
    rows = [(i % 10, i % 11, None if i == 0 else i % 10, str(i % 2)) for i in range(110)]
    df = spark.createDataFrame(rows, "ten int, eleven int, ten_and_null int, text string")
    assert {r["variable"]: r["unique_values"] for r in profile.profile_cardinality(df).collect()} == {"ten": 10}
    kinds = profile.classify_columns(df)
    assert kinds == {"ten": "categorical", "eleven": "continuous", "ten_and_null": "continuous", "text": "categorical"}


def test_pruning():
    names = ["EQ5D", "x_EQ5", "previous1", "SF36_a", "reasonStopX", "times", "a_n", "n_a", "score12", "score_12", "s121"]
    kept = [n for n in names if not any(__import__("re").search(p, n) for p in profile.EXCLUDED_PATTERNS)]
    assert kept == ["x_EQ5", "n_a", "s121"]
    assert len(profile.EXCLUDED_COLUMNS) == 94 and len(encode.ENCODED_COLUMNS) == 35


def test_encoding(spark):
    df = spark.createDataFrame(
        [(1, "b", 10, True), (2, None, 9, False), (3, "a", None, None)], "row_id int, c string, k int, t boolean"
    )
    hot = encode.one_hot(encode.fill_missing_level(df, ["c", "absent"]), ["c"])
    assert hot.columns == ["row_id", "k", "t", "c.a", "c.b", "c.missing"]
    assert hot.select("`c.missing`").collect()[1][0] == 1.0
    codes = encode.ordinal_encode(encode.cast_bools(df), ["c", "k"]).collect()
    assert [(r["c"], r["k"], r["t"]) for r in codes] == [(2.0, 2.0, 1.0), (None, 1.0, 0.0), (1.0, None, None)]
    with pytest.raises(ValueError):
        encode.collect_levels(df, ["c"], limit=1)
    with pytest.raises(ValueError):
        encode.require_columns(df, ["absent"])
    with pytest.raises(ValueError):
        encode.assert_same_features(["a"], ["b"])
    names = encode.expand_features(["Pain", "Pain.x", "Pain_y", "Painful", "a.b", "aXb"], ["Pain", "a.b"])
    assert names == ["Pain", "Pain.x", "Pain_y", "a.b"]
    with pytest.raises(ValueError):
        encode.expand_features(["x"], ["y"])


def test_binary_target_rejects_other_values(spark):
    good = spark.createDataFrame([(1.0,), (0.0,), (None,)], "y double")
    assert [r[0] for r in encode.binary_target(good, "y").collect()] == [1, 0, None]
    with pytest.raises(Exception, match="must be 0 or 1"):
        encode.binary_target(spark.createDataFrame([(2.0,)], "y double"), "y").collect()
