from __future__ import annotations

import pytest

from tablecare.operators import datasets

ROWS = [
    ("UTI", "amox", "5", "A", "2024-01-05"), ("UTI", "amox", "7", "A", "2024-01-20"), ("uti ", "cipro", "9", "B", "2024-02-01"),
    ("flu", "amox", "N/A", "B", "03/04/2024"), ("flu", None, "pending", "A", "2024-04-01"), (None, "cipro", "3", "A", "2024-04-30"),
]


@pytest.fixture
def visits(frame):
    return frame("Dx, Drug, Days, Ward, Visit_date", ROWS)


def is_time(data):
    return data.total.select(data.is_time).first()[0]


def points(df):
    return [(r["label"], r["value"]) for r in df.collect()]


def test_categorical_measures(visits):
    of = lambda how: datasets.categorical(visits, "Dx", "row_id", None if how == "count" else "Days", how)
    assert points(datasets.in_order(of("count"))) == [("UTI", 3.0), ("flu", 2.0)]
    assert points(datasets.in_order(of("sum"))) == [("UTI", 21.0), ("flu", 0.0)]
    for how in ("average", "median"):
        data = of(how)
        assert points(data.points) == [("UTI", 7.0)] and data.no_data.first()["label"] == "flu"


def test_periods_are_in_time_order_and_unreadable_ones_named(visits):
    data = datasets.categorical(visits, "Visit_date", "row_id", bucket="month")
    assert sorted(points(data.points)) == [("2024-01", 2.0), ("2024-02", 1.0), ("2024-04", 2.0)]
    clean = datasets.categorical(visits.filter("Visit_date NOT LIKE '%/%'"), "Visit_date", "row_id", bucket="month")
    assert [p[0] for p in points(datasets.in_order(clean))] == ["2024-01", "2024-02", "2024-04"]
    assert [r["value"] for r in data.unreadable_periods.collect()] == ["03/04/2024"]
    quarters = datasets.categorical(visits, "Visit_date", "row_id", bucket="quarter")
    assert points(quarters.points.orderBy("label")) == [("2024-Q1", 3.0), ("2024-Q2", 2.0)]


def test_time_labels_sort_only_when_all_parse(frame):
    df = frame("m", [("Mar 2024",), ("Jan 2024",), ("Feb 2024",), ("Jan 2024",)])
    data = datasets.categorical(df, "m", "row_id")
    assert is_time(data) and points(datasets.in_order(data))[0] == ("Jan 2024", 2.0)
    mixed = frame("m", [("2024-03",)] * 55 + [("2024-01",), ("no date",)])
    data = datasets.categorical(mixed, "m", "row_id")
    assert not is_time(data) and [p[0] for p in points(datasets.in_order(data))] == ["2024-03", "2024-01", "no date"]
    wards = frame("m", [("2024-03",)] * 50 + [(f"Ward {i % 7}",) for i in range(500)])
    assert datasets.pareto(datasets.categorical(wards, "m", "row_id")).count() == 8


def test_pareto(frame):
    df = frame("Drug", [(d,) for d, n in zip("abcdef", (8, 5, 3, 2, 1, 1)) for _ in range(n)])
    ranked = datasets.pareto(datasets.categorical(df, "Drug", "row_id")).orderBy("position")
    assert [r["cum_pct"] for r in ranked.collect()] == [40.0, 65.0, 80.0, 90.0, 95.0, 100.0]
    assert tuple(datasets.pareto_summary(ranked).first()) == (3, 6, 80)
    one = datasets.categorical(df.filter("Drug = 'a'"), "Drug", "row_id")
    assert datasets.pareto(one).count() == 0 and datasets.extreme(one).count() == 0


def test_extreme_needs_a_single_leader(frame):
    tie = frame("d", [("a",), ("b",)])
    assert datasets.extreme(datasets.categorical(tie, "d", "row_id")).count() == 0
    led = frame("d", [("a",), ("b",), ("b",)])
    assert datasets.extreme(datasets.categorical(led, "d", "row_id")).first()["statement"] == "Most common: b (67%)"


def test_small_categories_fold_and_rank_caps_keep_ties(frame):
    df = frame("d", [("big",)] * 98 + [("x",), ("y",)])
    assert points(datasets.fold_small(datasets.categorical(df, "d", "row_id"))) == [("big", 98.0), ("Other (2 smaller groups)", 2.0)]
    assert len(points(datasets.fold_small(datasets.categorical(df.filter("d <> 'y'"), "d", "row_id")))) == 2
    assert datasets.cap_rank(datasets.categorical(df, "d", "row_id"), 1, least=True).points.count() == 2


def test_crosstab_folds_the_ninth_subgroup(frame):
    df = frame("l, s", [("A", f"s{i}") for i in range(10) for _ in range(10 - i)] + [("B", "s9")])
    tab = datasets.crosstab(df, "l", "s", "row_id")
    cells = {(r["label"], r["subgroup"]): r["value"] for r in tab.cells.collect()}
    assert len(cells) == 16 and cells[("A", "Other (3 smaller groups)")] == 6.0
    assert cells[("B", "s0")] == 0.0 and cells[("B", "Other (3 smaller groups)")] == 1.0
    assert sum(cells.values()) == df.count()


def test_crosstab_measures_leave_empty_cells_null(visits):
    tab = {(r["label"], r["subgroup"]): r["value"] for r in datasets.crosstab(visits, "Dx", "Ward", "row_id", "Days", "median").cells.collect()}
    assert tab == {("UTI", "A"): 6.0, ("UTI", "B"): 9.0, ("flu", "A"): None, ("flu", "B"): None}


@pytest.mark.parametrize("values, bins", [
    ([5, 7, 10, 7], [("5.0", 1), ("6.0", 0), ("7.0", 2), ("8.0", 0), ("9.0", 0), ("10.0", 1)]),
    ([0.5, 99.5], [(f"{10.0 * i}", 1 if i in (0, 9) else 0) for i in range(10)]), ([4.5], [("4.5", 1)]), ([], []),
])
def test_histogram(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    got = datasets.histogram(df, "x").collect()
    assert [(str(r["from"]), r["n"]) for r in got] == bins and sum(r["n"] for r in got) == len(values)


def test_box_dot_shows_values_of_small_groups_only(spark):
    df = spark.range(151).selectExpr("id", "CASE WHEN id < 50 THEN 'a' WHEN id < 101 THEN 'b' WHEN id < 150 THEN 'c' END AS g", "CAST(id AS DOUBLE) AS x")
    got = {r["label"]: r for r in datasets.box_dot(df, "g", "x", "id").collect()}
    assert got["a"]["values"] == [float(i) for i in range(50)] and got["b"]["values"] is None and got["b"]["n"] == 51
    assert [r["label"] for r in datasets.box_dot(df, "g", "x", "id").collect()] == ["c", "b", "a"]


@pytest.mark.parametrize("n, cap", [(0, 10), (9, 10), (11, 10), (137, 10), (3000, 77)])
def test_scatter_positions_under_any_spread_of_the_order(spark, n, cap):
    for keys in ([i * 7919 % 10007 for i in range(n)], [i if i < n * 0.8 else i * 10**12 for i in range(n)]):
        rows = [(k, float(i), 0.5) for i, k in enumerate(keys)]
        df = spark.createDataFrame(rows, "k long, x double, y double").repartition(4)
        got = {(r["position"], r["x"]) for r in datasets.scatter(df, "x", "y", "k", cap=cap).collect()}
        order = sorted(rows)
        assert got == {(p, order[p][1]) for p in ([int(i * (n / cap)) for i in range(cap)] if n > cap else range(n))}


def test_scatter_takes_evenly_spaced_points(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id", "CAST(id % 100 AS DOUBLE) AS x", "CAST((id * 7) % 50 AS DOUBLE) AS y")
    got = datasets.scatter(df, "x", "y", "id").orderBy("position").collect()
    assert [r["position"] for r in got] == [int(i * 5000 / 2000) for i in range(2000)] and got[0]["total_points"] == 5000
    assert datasets.scatter(df.limit(30), "x", "y", "id").count() == 30


def test_small_multiples_share_a_scale(frame):
    df = frame("l, s", [(f"l{i:02d}", "s") for i in range(14) for _ in range(20 - i)])
    got = datasets.small_multiples(datasets.crosstab(df, "l", "s", "row_id")).collect()
    assert len(got) == 12 and {r["max_value"] for r in got} == {20.0} and {r["hidden"] for r in got} == {2}


def test_reference_line_and_sort(visits):
    data = datasets.categorical(visits, "Drug", "row_id")
    assert datasets.reference_line(data).first()[0] == 2.5
    assert [p[0] for p in points(datasets.sort_points(data, "alpha"))] == ["amox", "cipro"]
