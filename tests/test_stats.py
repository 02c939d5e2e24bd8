from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablecare.functions import distributions as dist
from tablecare.operators import stats
from tablecare.operators.conditions import equals


@pytest.fixture
def table_of(frame):
    """Rows from a 2 by 2 table of counts."""
    def make(a, b, c, d):
        cells = [("g1", "yes")] * a + [("g1", "no")] * b + [("g2", "yes")] * c + [("g2", "no")] * d
        return frame("Group, Outcome", cells)

    return make


def test_tails_match_published_values():
    assert dist.chi_square_tail([3.841, 5.991, 0.0], [1, 2, 3]) == pytest.approx([0.05, 0.05, 1.0], abs=1e-4)
    assert dist.t_two_sided([2.228, -12.706, 0.0], [10, 1, 5]) == pytest.approx([0.05, 0.05, 1.0], abs=1e-4)
    assert dist.normal_two_sided(np.array([1.959964])) == pytest.approx([0.05], abs=1e-6)
    assert dist.z_for(0.95) == pytest.approx(1.959964, abs=1e-6)
    assert dist.t_multiplier([8.0, 1.0, 1e7], 0.95) == pytest.approx([2.306004, 12.706205, 1.959964], abs=1e-5)


@pytest.mark.parametrize("df", [99_999.0, 1e5, 1e6, 1e8, 1e10])
def test_tails_of_large_tables(df):
    """Against the first terms of the expansions in 1 / df."""
    p = 0.5 - 1 / (3 * np.sqrt(np.pi * df))
    assert dist.chi_square_tail([df], [df]) == pytest.approx([p], abs=2 / df**1.5)
    z = np.array([0.5, 2.0, 5.0])
    density = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
    wanted = dist.normal_two_sided(z) + density * z * (z * z + 1) / (2 * df)
    assert dist.t_two_sided(z, df) == pytest.approx(wanted, abs=30 / df**2 + 1e-14)
    # The three moments of a chi-square variable turn it normal.
    cube = np.cbrt(1 + 3 * np.sqrt(2 / df)) - (1 - 2 / (9 * df))
    assert dist.chi_square_tail([df + 3 * np.sqrt(2 * df)], [df])[0] == pytest.approx(dist.normal_two_sided(np.array([cube / np.sqrt(2 / (9 * df))]))[0] / 2, rel=1e-3)


def test_tails_are_smooth_where_the_method_changes():
    below, above = dist.chi_square_tail([2e5 - 0.2, 2e5 + 0.2], [2e5 - 0.2, 2e5 + 0.2])
    assert below == pytest.approx(above, abs=1e-8)
    assert dist.t_two_sided([3.0], [1e5 - 0.01]) == pytest.approx(dist.t_two_sided([3.0], [1e5]), rel=1e-9)


@pytest.mark.parametrize("cells, p", [((3, 1, 1, 3), 0.4857), ((1, 9, 11, 3), 0.00276), ((0, 5, 5, 0), 0.00794)])
def test_fisher(cells, p):
    assert dist.fisher_tails(*cells)[0] == pytest.approx(p, abs=5e-5)


def test_fisher_on_huge_counts_stays_small_in_memory():
    two, less, greater = dist.fisher_tails(5e8, 5e8, 5e8, 5e8)
    assert two == pytest.approx(1.0, abs=1e-3) and less + greater == pytest.approx(1.0, abs=1e-3)
    assert dist.fisher_tails(6e8, 4e8, 5e8, 5e8)[0] == 0.0


def test_chi_square_with_effects(table_of):
    got = stats.table_test(table_of(12, 8, 5, 15), "Group", "Outcome", "row_id").first()
    assert (got["test"], got["df"], got["reliable"], got["min_expected"]) == ("chi-square", 1, True, 8.5)
    assert got["chi_square"] == pytest.approx(5.013, abs=1e-3) and got["p"] == pytest.approx(0.0252, abs=1e-4)
    assert [got[c] for c in ("odds_ratio", "odds_ratio_lo", "odds_ratio_hi")] == pytest.approx([4.5, 1.16, 17.4], abs=0.05)
    assert [got[c] for c in ("risk_ratio", "risk_ratio_lo", "risk_ratio_hi")] == pytest.approx([2.4, 1.04, 5.55], abs=0.01)


def test_sparse_tables_use_the_exact_test(table_of, frame):
    got = stats.table_test(table_of(3, 1, 1, 3), "Group", "Outcome", "row_id").first()
    assert (got["test"], got["reliable"]) == ("fisher", False) and got["p"] == pytest.approx(0.4857, abs=1e-4)
    larger = frame("a, b", [("x", "1"), ("x", "2"), ("y", "2"), ("z", "3"), ("z", "1")])
    got = stats.table_test(larger, "a", "b", "row_id").first()
    assert (got["test"], got["reliable"], got["df"], got["c11"]) == ("chi-square", False, 4, None)


def test_empty_cells_are_corrected(table_of):
    got = stats.table_test(table_of(0, 10, 5, 5), "Group", "Outcome", "row_id").first()
    assert got["odds_ratio"] == pytest.approx(21.0) and got["odds_ratio_lo"] > 0


def test_ratios_of_huge_counts(spark):
    cells = [F.col(c) for c in "abcd"]
    df = spark.createDataFrame([(10**9, 2 * 10**9, 3 * 10**9, 4 * 10**9), (0, 10, 5, 5)], "a long, b long, c long, d long")
    odds = [r[0] for r in df.select(*stats.odds_ratio(*cells)).collect()]
    risk = [r[0] for r in df.select(*stats.risk_ratio(*cells)).collect()]
    assert odds == pytest.approx([4 / 6, 0.5 * 5.5 / (10.5 * 5.5)]) and risk == pytest.approx([7 / 9, (0.5 / 11) / 0.5])


def test_expected_counts_of_huge_tables(frame, monkeypatch):
    df = frame("a, b", [("x", "1"), ("x", "2"), ("y", "1"), ("y", "2"), ("y", "2")])
    one = stats._spelled(df, "a", "b", "row_id", [])
    monkeypatch.setattr(stats, "_spelled", lambda *_: one.withColumn("n", F.col("n") * 4 * 10**9))
    got = stats.contingency(df, "a", "b", "row_id").first()
    assert got["chi_square"] == pytest.approx(5 / 36 * 4e9) and got["min_expected"] == pytest.approx(0.8 * 4e9)
    assert stats.contingency_cells(df, "a", "b", "row_id").filter("a_key = 'x' AND b_key = '1'").first()["expected"] == pytest.approx(0.8 * 4e9)


def test_welch(spark):
    cells = [("a", float(x)) for x in range(1, 6)] + [("b", float(x)) for x in range(3, 8)] + [("a", None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "row_id long, g string, x double")
    got = stats.welch(df, "x", "g", "row_id").first()
    assert (got["t"], got["df"], got["n_a"], got["status"]) == (pytest.approx(-2.0), pytest.approx(8.0), 5, "ok")
    assert got["p"] == pytest.approx(0.0805, abs=1e-4) and (got["lo"], got["hi"]) == (pytest.approx(-4.306, abs=1e-3), pytest.approx(0.306, abs=1e-3))


@pytest.mark.parametrize("cells, status", [
    ([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 1.0)], "no variation to test"), ([("a", 1.0), ("b", 1.0), ("b", 2.0)], "needs two numbers in each group"),
    ([("a", 1.0), ("a", 2.0)], "needs exactly two groups"),
])
def test_welch_says_why_it_refuses(spark, cells, status):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cells)], "row_id long, g string, x double")
    got = stats.welch(df, "x", "g", "row_id").first()
    assert (got["status"], got["p"], got["t"]) == (status, None, None)


def test_the_columns_choose_the_test(frame):
    df = frame("g, o, x, y", [("a", "1x", "1", "2"), ("a", "2x", "2", "3"), ("b", "1x", "5", "4"), ("b", "2x", "7", "9")])
    assert stats.choose_test(df, "x", "g", "row_id").first()["group_a"] == "a"
    assert stats.choose_test(df, "g", "o", "row_id").first()["test"] == "fisher"
    with pytest.raises(ValueError, match="both columns are numbers"):
        stats.choose_test(df, "x", "y", "row_id")


def test_wilson(frame):
    df = frame("o", [("yes",)] * 12 + [("no",)] * 8)
    got = stats.proportion(df, equals("o", "yes")).first()
    assert (got["x"], got["n"], got["proportion"]) == (12, 20, 0.6) and (got["lo"], got["hi"]) == (pytest.approx(0.386, abs=1e-3), pytest.approx(0.781, abs=1e-3))


def test_segments_are_tested_on_their_own(frame):
    cells = [("s1", "a", "y"), ("s1", "b", "n"), ("s1", "a", "y"), ("s2", "a", "y"), ("s2", "a", "n")]
    got = stats.contingency(frame("seg, g, o", cells), "g", "o", "row_id", ["seg"]).collect()
    assert [r["seg"] for r in got] == ["s1"] and (got[0]["c11"], got[0]["c22"]) == (2, 1)


@pytest.mark.parametrize("kind, predictors, repeated, decision, reason", [
    ("yesno", 2, False, "refuse", "too few events"), ("yesno", 1, False, "proceed", None), ("yesno", 1, True, "refuse", "repeated measures"),
    ("measurement", 3, False, "proceed", None), ("yesno", 0, False, "refuse", "no predictor"), ("other", 1, False, "refuse", "unknown outcome"),
])
def test_events_per_predictor(frame, kind, predictors, repeated, decision, reason):
    df = frame("o", [("yes",)] * 15 + [("no",)] * 20)
    got = stats.epv_gate(df, kind, predictors, equals("o", "yes"), repeated).first()
    assert (got["decision"], got["reason"]) == (decision, reason)


def test_regression(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=400)
    y = 2.0 + 3.0 * x + rng.normal(size=400)
    z = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.5 + 1.2 * x)))).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c), "u" if i % 3 else "v") for i, (a, b, c) in enumerate(zip(x, y, z))],
                               "`x value` double, y double, z double, ward string")
    design = np.column_stack([np.ones(400), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    got = {r["term"]: r for r in stats.regress(df, "y", ["x value"], "linear").collect()}
    assert [got["(intercept)"]["estimate"], got["x value"]["estimate"]] == pytest.approx(list(beta), abs=1e-6)
    assert got["x value"]["lo"] < 3.0 < got["x value"]["hi"]
    odds = {r["term"]: r for r in stats.regress(df, "z", ["x value", "ward"], "logistic").collect()}
    assert odds["x value"]["or_lo"] > 1 and odds["x value"]["odds_ratio"] == pytest.approx(np.exp(odds["x value"]["estimate"]))
    assert len(odds) == 3 and any(t.startswith("ward = ") for t in odds)
