from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablecare.operators import joins, reshape
from tablecare.operators.rows import dedupe_encounters, dedupe_rows, keep_one

VISITS = [
    ("M1", "2024-03-01", "A", "x"), ("M1", "2024-01-05", "B", "y"), ("M2", "2024-02-01", "A", None), (None, "2024-02-02", "C", "z"),
    ("m3 ", None, "A", "q"), ("M3", "2024-05-01", None, None),
]


@pytest.fixture
def visits(frame):
    return frame("MRN, Visit_date, Ward, Note", VISITS)


@pytest.mark.parametrize("policy, kept", [
    ("first::Visit_date", [1, 2, 3, 5]), ("last::Visit_date", [0, 2, 3, 5]), ("complete", [0, 2, 3, 4]),
    ("firstrow", [0, 2, 3, 4]), ("lastrow", [1, 2, 3, 5]),
])
def test_one_row_per_patient(visits, rows, policy, kept):
    split = keep_one(visits, "MRN", policy, "row_id")
    assert [r[0] for r in rows(split.kept, "row_id")] == kept
    assert split.kept.count() + split.removed.count() == visits.count()


def test_blank_ids_are_all_kept_even_when_they_are_most_rows(frame):
    df = frame("id, d", [(None if i % 10 else "P1", str(i)) for i in range(200)])
    assert keep_one(df, "id", "last::d", "row_id").kept.count() == 181


def test_no_row_is_lost_where_the_order_repeats(spark):
    df = spark.createDataFrame(
        [("2024-01-01", None, "a"), ("2024-01-01", " ", "b"), ("2024-01-01", "P1", "c"), ("2024-01-01", "P1", "d"), ("2024-01-01", "P1", "d")],
        "day string, id string, note string",
    ).repartition(3)
    for split in (keep_one(df, "id", "first::day", "day"), keep_one(df, "id", "complete", "day"), dedupe_rows(df, "day"), dedupe_encounters(df, "id", "day")):
        together = sorted([tuple(r) for r in split.kept.unionByName(split.removed).collect()], key=repr)
        assert together == sorted([tuple(r) for r in df.collect()], key=repr)
        assert {r["note"] for r in split.kept.collect()} >= {"a", "b"}
    assert keep_one(df, "id", "first::day", "day").removed.count() == 2


def test_exact_copies(frame, rows):
    df = frame("CSN, Drug", [("1", "a"), ("1", "a"), ("2", "a"), (None, "b"), (None, "b"), ("2", "c")])
    split = dedupe_rows(df, "row_id")
    assert rows(split.kept, "row_id") == [(0,), (2,), (3,), (5,)] and rows(split.removed, "row_id") == [(1,), (4,)]
    assert rows(dedupe_encounters(df, "CSN", "row_id").removed, "row_id") == [(1,)]


def test_dedupe_with_a_struct_of_two_order_columns(spark, rows):
    df = spark.createDataFrame([(1, 2, "a"), (1, 1, "a"), (0, 9, "b")], "f int, p int, v string")
    assert rows(dedupe_rows(df, ["f", "p"]).kept) == [(0, 9, "b"), (1, 1, "a")]


def test_anti_join(frame, rows):
    a = frame("id", [("P1",), (" p2",), ("P3",), (None,), ("",)])
    b = frame("id", [("P2",), (None,), ("P2",)])
    assert rows(joins.anti_join(a, b, "id"), "row_id") == [(0,), (2,), (4,)]


def test_lookup_takes_the_first_match(frame, rows):
    a = frame("Drug", [("Amox",), ("cipro",), ("mystery",), (None,)])
    b = frame("Drug, Class", [("cipro", "quinolone"), ("amox ", "beta-lactam"), ("AMOX", "other")])
    got = joins.lookup_join(a, b, "Drug", ["Class"], "row_id")
    assert rows(got.rows, "row_id", "Class") == [(0, "beta-lactam"), (1, "quinolone"), (2, None), (3, None)]
    assert rows(got.unmatched, "row_id") == [(2,), (3,)]


def test_as_of_takes_the_latest_prior(frame, rows):
    events = frame("id, day", [("P1", "2024-03-10"), ("P1", "2024-01-05"), (None, "2024-03-10"), ("P2", "2024-02-01"), ("P1", "soon")])
    priors = frame("id, day, v", [
        ("p1", "2024-02-01", "10"), ("P1", "2024-03-01", "20"), ("P1", "2024-03-01", "21"), ("P2", "2024-02-01", "5"), ("P1", "later", "0"),
    ])
    got = joins.as_of_join(events, priors, "id", "day", ["v"], "row_id")
    assert rows(got.rows, "row_id", "prior_v") == [(0, "21"), (1, "0"), (2, None), (3, "5"), (4, "0")]
    assert rows(got.unmatched, "row_id") == [(2,)]


@pytest.mark.parametrize("width", [1.0, 7.0, 1e9, None])
def test_as_of_does_not_depend_on_the_slices(spark, width):
    """A hot key with most rows, checked against a plain search."""
    events = spark.range(400).selectExpr("id", "CASE WHEN id % 10 = 0 THEN id % 7 ELSE 99 END AS k", "(id * 37 % 211) + 0.5 AS t")
    priors = spark.range(300).selectExpr("id", "CASE WHEN id % 9 = 0 THEN id % 7 ELSE 99 END AS k", "CAST(id * 53 % 197 AS DOUBLE) AS t")
    got = {r["id"]: r["prior_id"] for r in joins.as_of_join(events, priors, "k", "t", ["id"], "id", slice_width=width).rows.collect()}
    known = [(r["k"], r["t"], r["id"]) for r in priors.collect()]
    for e in events.collect():
        before = [(t, i) for k, t, i in known if k == e["k"] and t <= e["t"]]
        assert got[e["id"]] == (max(before)[1] if before else None)


def test_off_vocabulary(frame, spark, rows):
    df = frame("Diagnosis, Ward", [("Pyelonefritis", "A"), ("  cystitis ", "B"), ("Pyelonefritis", "Z"), (None, "Q")])
    vocab = spark.createDataFrame([("Diagnosis", t) for t in ("cUTI", "Pyelonephritis", "Cystitis")], "column string, term string")
    assert rows(joins.off_vocabulary(df.drop("row_id"), vocab)) == [("Diagnosis", "Pyelonefritis", 2)]


def test_split_rows_and_pairs(frame, rows):
    df = frame("Drug, Dose", [("a, b", "1, 2"), ("a, b, c", "1, 2"), ("x", "9"), (None, "1; 2")])
    assert rows(reshape.split_rows(df, "Drug"), "row_id", "Drug")[:2] == [(0, "a"), (0, "b")]
    assert reshape.split_rows(df, "Drug").filter("row_id = 3").first()["Drug"] is None
    paired = reshape.explode_paired(df, "Drug", "Dose")
    assert rows(paired.rows, "Drug", "Dose") == [("a", "1"), ("b", "2"), ("x", "9")]
    assert rows(paired.mismatched, "row_id") == [(1,), (3,)]


def test_long_to_wide(frame, rows):
    df = frame("pid, test, val", [("P1", "Na", "140"), ("P1", "K", "4"), ("p1 ", "Na", "141"), ("P2", "pid", "7"), (None, "Na", "1")])
    wide = reshape.long_to_wide(df, "pid", "test", "val", "row_id")
    assert set(wide.rows.columns) == {"pid", "Na", "K", "pid (value)"}
    assert rows(wide.rows, "pid", "Na", "K", "`pid (value)`") == [("P1", "141", "4", None), ("P2", None, None, "7")]
    assert wide.collisions.first()[0] == 1


def test_wide_to_long_drops_blanks(frame, rows):
    df = frame("pid, Na, K", [("P1", "140", None), ("P2", " ", "4")])
    assert rows(reshape.wide_to_long(df, "pid", ["Na", "K"])) == [("P1", "Na", "140"), ("P2", "K", "4")]


def test_as_of_cuts_a_key_whose_rows_lie_in_one_day(spark):
    at = lambda i: f"2024-01-01 {i // 60 % 24:02d}:{i % 60:02d}:00"
    events = spark.createDataFrame([("hot", at(i * 7 % 1440), i) for i in range(400)] + [(None, at(5), 900), ("b", at(9), 901)], "k string, t string, i int")
    priors = spark.createDataFrame([("hot", at(i * 11 % 1440), i) for i in range(300)] + [("b", at(10), 901), (None, at(1), 902)], "k string, t string, p int")
    timed = lambda df: df.withColumn("t", F.to_timestamp("t"))
    got = {r["i"]: r["prior_p"] for r in joins.as_of_join(timed(events), timed(priors), "k", "t", ["p"], "p").rows.collect()}
    latest = {i * 11 % 1440: i for i in range(300)}
    wanted = {i: max([(m, p) for m, p in latest.items() if m <= i * 7 % 1440], default=(0, None))[1] for i in range(400)}
    assert got == wanted | {900: None, 901: None}
