"""Report tables and test statistics."""

import math

import pytest

from cohortia.functions.tails import lower_beta, upper_gamma
from cohortia.operators import encode, report


def integral(f, low, high, steps=20000):
    width = (high - low) / steps
    return sum(f(low + (i + 0.5) * width) for i in range(steps)) * width


@pytest.mark.parametrize(("df", "x"), [(1, 3.841458820694124), (2, 0.3), (5, 11.07), (40, 30.0), (3, 60.0)])
def test_chi_square_tail(df, x):
    density = lambda t: t ** (df / 2 - 1) * math.exp(-t / 2) / (2 ** (df / 2) * math.gamma(df / 2))
    assert upper_gamma(df / 2, x / 2) == pytest.approx(integral(density, x, x + 200), rel=2e-3)


def test_known_tails():
    assert upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-12)
    assert upper_gamma(1.0, 2.0) == pytest.approx(math.exp(-2), rel=1e-13)
    assert lower_beta(1, 1, 0.3) == pytest.approx(0.3) and lower_beta(2, 3, 0.4) == pytest.approx(0.5248)
    assert lower_beta(0.5, 0.5, 0.5) == pytest.approx(0.5)
    # F(2, 12) = 3.885 is the 5% point.
    assert lower_beta(6, 1, 12 / (12 + 2 * 3.885293835)) == pytest.approx(0.05, abs=1e-6)


def test_one_way_test(spark):
    groups = {"train": [6, 8, 4, 5, 3, 4], "test": [8, 12, 9, 11, 6, 8], "external": [13, 9, 11, 8, 7, 12]}
    rows = [(s, float(x), float(x) if s == "train" else None) for s, xs in groups.items() for x in xs]
    rows.append(("train", None, float("nan")))
    df = spark.createDataFrame(rows, "split string, x double, only double")
    table = {(r["variable"], r["split"]): r for r in report.table_one_continuous(df, ["x", "only"]).collect()}
    row = table["x", "train"]
    assert (row["n"], row["mean"], row["df1"], row["df2"]) == (6, 5.0, 2, 15)
    assert row["f_stat"] == pytest.approx(9.264705882) and row["p_value"] == pytest.approx(0.0023987773, abs=1e-7)
    assert table["only", "train"]["n"] == 6 and table["only", "test"]["n"] == 0
    assert table["only", "train"]["f_stat"] is None


def test_chi_square(spark):
    cells = {("train", "a"): 10, ("train", "b"): 20, ("test", "a"): 30, ("test", "b"): 5}
    rows = [(s, v, v if s == "train" else "c", "same") for (s, v), n in cells.items() for _ in range(n)]
    rows.append(("test", None, None, "same"))
    df = spark.createDataFrame(rows, "split string, v string, w string, one string")
    table = report.table_one_categorical(df, ["v", "w", "one"], values=["train", "test"]).collect()
    found = {(r["variable"], r["level"], r["split"]): r for r in table}
    gap = abs(10 - 30 * 40 / 65) - 0.5
    expected = sum(gap**2 / (r * c / 65) for r in (30, 35) for c in (40, 25))
    row = found["v", "a", "train"]
    assert row["n"] == 10 and row["percent"] == pytest.approx(100 / 3) and row["df"] == 1
    assert row["chi2"] == pytest.approx(expected)
    assert row["p_value"] == pytest.approx(math.erfc(math.sqrt(expected / 2)), rel=1e-9)
    # Cells without rows are part of the table and of the statistic.
    empty = found["w", "a", "test"]
    assert empty["n"] == 0 and empty["df"] == 2
    assert empty["chi2"] == pytest.approx(65.0)
    assert found["one", "same", "train"]["chi2"] is None


def test_missingness_and_frequencies(spark):
    rows = [("train", None, 1.0), ("train", float("nan"), 1.0), ("train", 2.0, 1.0), ("test", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "split string, x double, y double")
    found = report.missingness(df, ["x", "y"]).collect()
    assert [(r["split"], r["variable"], r["missing_count"], r["missing_percent"]) for r in found] == [
        ("train", "x", 2, 66.7)
    ]
    flagged = report.flag_at_most(encode.nan_to_null(df), "x", 1.5, "low")
    freq = {(r["split"], r["low"]): (r["n"], r["percent"]) for r in report.freq_table(flagged, "low", ["split"]).collect()}
    assert freq == {("train", 0): (1, 100.0), ("test", 1): (1, 100.0)}
