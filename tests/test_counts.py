from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablecare.operators import aggregate, ranking
from tablecare.operators.conditions import (
    Condition, Definition, definition_flags, entity_flags, equals, keep, keep_groups, keep_listed, missing, one_of, present, threshold,
)
from tablecare.operators.quantiles import exact_quantiles

VISITS = [
    ("cystitis", "cephalexin", "10", "P1"), ("pyelonephritis", "amoxicillin", "8", "P1"), ("pyelonephritis", "cefpodoxime", "6", "P2"),
    ("UTI", "nitrofurantoin", "N/A", "P3"), (None, "Amoxicillin ", "9 days", "P4"),
]


@pytest.fixture
def visits(frame):
    return frame("Diagnosis, Drug, Duration_days, PatientID", VISITS)


def test_conditions_and_their_negation(visits, rows):
    ids = lambda c: [r[0] for r in rows(keep(visits, [c]), "row_id")]
    assert ids(equals("Drug", "amoxicillin")) == [1, 4]
    assert ids(equals("Diagnosis", "uti", negated=True)) == [0, 1, 2, 4]
    assert ids(one_of("Diagnosis", ["UTI", "Cystitis"])) == [0, 3]
    assert ids(one_of("Diagnosis", ["UTI", "Cystitis"]).negate()) == [1, 2, 4]
    assert ids(threshold("Duration_days", ">", 7)) == [0, 1, 4]
    assert ids(threshold("Duration_days", ">", 7).negate()) == [2]
    assert ids(threshold("Duration_days", ">", 7, when=("Diagnosis", "pyelonephritis"))) == [1]
    assert ids(missing("Duration_days")) == [3] and ids(present("Duration_days")) == [0, 1, 2, 4]


def test_conditions_round_trip_as_json():
    for c in (equals("a", "b", True), one_of("a", ["x", "y"]), threshold("n", ">=", 2.5, ("d", "z")), missing("q"), present("q")):
        assert Condition.from_json(c.to_json()) == c


def test_funnel_counts_and_shares(visits):
    stages = [one_of("Drug", ["cephalexin", "amoxicillin", "cefpodoxime"]), threshold("Duration_days", ">", 7)]
    got = [tuple(r) for r in aggregate.funnel(visits, stages).orderBy("stage").collect()]
    assert [(r[2], r[3], r[4]) for r in got] == [(4, 5, 80.0), (3, 4, 75.0)]
    assert [r[2] for r in got] == sorted([r[2] for r in got], reverse=True)


def test_entities_pass_by_any_row_and_fail_negations_by_any_row(visits):
    stages = [equals("Drug", "amoxicillin", negated=True)]
    got = {r["entity_key"]: r["pass_0"] for r in entity_flags(visits, "PatientID", stages).collect()}
    assert got == {"p1": False, "p2": True, "p3": True, "p4": False}
    assert tuple(aggregate.entity_funnel(visits, "PatientID", stages).first())[2:5] == (2, 4, 50.0)


def test_definitions_become_flags(visits):
    rules = [Definition("oral beta-lactams", "Drug", "values", values=("cephalexin", "Amoxicillin")),
             Definition("excess duration", "Duration_days", "threshold", ">", 7.0, ("Diagnosis", "pyelonephritis"))]
    flagged = definition_flags(visits, rules).agg(F.count_if("is_oralbetalactam"), F.count_if("is_excessduration")).first()
    assert tuple(flagged) == (3, 1)


def test_filter_groups(frame, rows):
    df = frame("Drug, Dx", [("cephalexin", "cystitis"), ("amoxicillin", "UTI"), ("amoxicillin", "cystitis"), (None, "UTI")])
    got = keep_groups(df, [[("Drug", "Cephalexin"), ("Dx", "cystitis")], [("Drug", "amoxicillin"), ("Dx", "uti")]])
    assert rows(got, "row_id") == [(0,), (1,)]
    assert keep_groups(df, [[], []]).count() == 4 and keep_groups(df, []).count() == 4
    tally = [tuple(r) for r in aggregate.preview_tally(df, [], ["Drug", "Dx"], "row_id").collect()]
    assert tally == [("cephalexin / cystitis", 1), ("amoxicillin / UTI", 1), ("amoxicillin / cystitis", 1)]


def test_keep_listed_keeps_null_cells_when_negated(frame, spark, rows):
    df = frame("k", [(" A",), ("b",), (None,)])
    listed = spark.createDataFrame([("a",), ("A",)], "v string")
    assert rows(keep_listed(df, "k", listed, "v"), "row_id") == [(0,)]
    assert rows(keep_listed(df, "k", listed, "v", negated=True), "row_id") == [(1,), (2,)]


def test_labels_are_first_seen_whatever_the_partitions(frame):
    cells = [("west",), ("West ",), ("WEST",), ("east",), ("West ",), (None,), (" ",)]
    for partitions in (1, 2, 5):
        df = frame("ward", cells, partitions)
        got = {r["key"]: (r["label"], r["n"]) for r in aggregate.value_counts(df, "ward", "row_id").collect()}
        assert got == {"west": ("west", 4), "east": ("east", 1)}


@pytest.mark.parametrize("values, want", [
    ([1, 2, 3, 4], (1.75, 2.5, 3.25)), ([3, 6, 7, 8, 8, 10, 13], (6.5, 8.0, 9.0)), ([5], (5.0, 5.0, 5.0)), ([], None),
])
def test_quartiles_interpolate(spark, values, want):
    df = spark.createDataFrame([("a", float(v)) for v in values], "g string, x double")
    got = [tuple(r)[1:] for r in exact_quantiles(df, ["g"], "x", aggregate.QUARTILES).collect()]
    assert got == ([want] if want else [])


def test_quartiles_are_exact_under_heavy_skew(spark):
    """One group holds nearly all rows, one value a third of them."""
    df = spark.range(30000).selectExpr(
        "CASE WHEN id % 100 = 0 THEN 'small' ELSE 'hot' END AS g",
        "CASE WHEN id % 3 = 0 THEN 7.0D ELSE (id * 7919 % 30011) / 3.0D END AS x",
    )
    probs = {"low": 0.001, "q1": 0.25, "median": 0.5, "high": 0.999}
    got = {r["g"]: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    frame = df.toPandas()
    for group, values in frame.groupby("g")["x"]:
        assert got[group] == pytest.approx([values.quantile(p) for p in probs.values()], abs=1e-9)


def test_sums_do_not_depend_on_the_row_order(spark):
    values = [0.1, 1e12, -1e12, 0.2, 0.3, 33333.33] * 50
    sums = set()
    for partitions in (1, 3, 7):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, x double").repartition(partitions, "i")
        for quartiles in (True, False):
            sums.add(aggregate.numeric_bundle(df, [], "x", quartiles).first()["sum"])
    assert sums == {50 * 33333.33 + 30}
    tiny = spark.createDataFrame([(1e-12,), (2e-12,)], "x double")
    assert aggregate.numeric_bundle(tiny, [], "x").first()["sum"] == pytest.approx(3e-12)


def test_statistics_of_messy_numbers(frame):
    df = frame("Duration_days", [("10",), ("6",), ("5",), ("N/A",), ("3",)])
    s = aggregate.summarise(df, "Duration_days", ["sum", "average", "quartiles", "stdev", "min", "max", "range"]).first()
    assert (s["n"], s["skipped"], s["sum"], s["average"], s["stdev"]) == (4, 1, 24.0, 6.0, 2.94)
    assert (s["q1"], s["median"], s["q3"], s["iqr"], s["min"], s["max"], s["range"]) == (4.5, 5.5, 7.0, 2.5, 3.0, 10.0, 7.0)
    none = aggregate.summarise(df.filter("row_id = 3"), "Duration_days", ["sum", "average", "median", "stdev"]).first()
    assert tuple(none)[2:] == (1, None, None, None, None)
    assert aggregate.summarise(df.filter("row_id = 0"), "Duration_days", ["stdev"]).first()["stdev"] is None


def test_describe_and_table1_text(frame):
    df = frame("Dx, Duration_days", [("UTI", "10"), ("uti ", "6"), ("flu", "5"), (None, "N/A"), ("UTI", "3")])
    assert tuple(aggregate.describe(df, "Duration_days").first()) == (4, 1, "6 (SD 2.94)", "5.5 (IQR 4.5–7)", "3–10 days")
    got = [tuple(r)[1:] for r in aggregate.table1(df, ["Dx", "Duration_days"], "row_id", ["Duration_days"]).collect()]
    assert got == [
        ("Dx — n (%)", "", 1), ("  UTI", "3 (75%)", None), ("  flu", "1 (25%)", None),
        ("Duration_days", "median 5.5 days (IQR 4.5–7); mean 6 (SD 2.94)", 1),
    ]


POOLED = [("P1", "UTI", "sepsis"), ("P1", "UTI", ""), ("P2", "sepsis", "uti"), ("P3", "sepsis", "UTI"), ("P3", "pyelonephritis", "")]


@pytest.mark.parametrize("policy, want", [
    ("occurrence", [("UTI", 4), ("sepsis", 3), ("pyelonephritis", 1)]), ("entity", [("UTI", 3), ("sepsis", 3), ("pyelonephritis", 1)]),
])
def test_pooled_policies(frame, policy, want):
    df = frame("PatientID, Primary, Secondary", POOLED)
    got = ranking.top_pooled(df, ["Primary", "Secondary"], "row_id", policy, "PatientID").collect()
    assert [(r["label"], r["n"]) for r in got] == want
    assert tuple(aggregate.pooled_totals(df, ["Primary", "Secondary"]).first()) == (5, 2, 0)


def test_pooled_row_policy_counts_a_value_once_per_row(frame):
    df = frame("PatientID, a, b", [("P1", "x", "X "), (None, "x", "y"), (None, "x", "x")])
    by = lambda policy: {r["key"]: r["n"] for r in aggregate.pooled_counts(df, ["a", "b"], "row_id", policy, "PatientID").collect()}
    assert by("occurrence") == {"x": 5, "y": 1} and by("row") == {"x": 3, "y": 1} and by("entity") == {"x": 3, "y": 1}


def test_ties_at_the_cutoff_are_kept(frame):
    df = frame("dx", [("a",), ("a",), ("b",), ("b",), ("c",), (None,)])
    top = [tuple(r)[:3] for r in ranking.top_frequency(df, "dx", "row_id", n=1).collect()]
    assert top == [("a", 2, 40.0), ("b", 2, 40.0)]
    assert [r["label"] for r in ranking.top_frequency(df, "dx", "row_id", n=1, least=True).collect()] == ["c"]


def test_magnitude_ranks_run_on_over_ties(frame):
    df = frame("x", [("5",), ("9 days",), ("9",), ("n/a",), ("9",), ("1",)], partitions=4)
    got = ranking.top_magnitude(df, "x", "row_id", n=2).orderBy("Rank").collect()
    assert [(r["Rank"], r["row_id"]) for r in got] == [(1, 1), (2, 2), (3, 4)]
    everything = ranking.top_magnitude(df, "x", "row_id", least=True).orderBy("Rank").collect()
    assert [(r["Rank"], r["row_id"]) for r in everything] == [(1, 5), (2, 0), (3, 1), (4, 2), (5, 4)]
    assert ranking.unreadable_count(df, "x").first()[0] == 1


def test_sorted_lists_put_blanks_last(frame):
    df = frame("x", [("b",), ("10",), (None,), ("2",), ("A",), (" ",)])
    order = lambda descending: [r["row_id"] for r in ranking.sort_rows(df, "x", "row_id", descending).collect()]
    assert order(False) == [3, 1, 4, 0, 2, 5]
    assert order(True)[:2] == [1, 3] and order(True)[-2:] == [2, 5]


def test_one_row_per_entity_in_lists(frame):
    df = frame("id, v", [("P1", "1"), ("p1 ", "2"), (None, "3"), ("", "4"), ("P2", "5")])
    got = ranking.list_rows(df, [present("v")], "row_id", entity="id", sort=("v", True)).collect()
    assert [r["row_id"] for r in got] == [4, 2, 0]
