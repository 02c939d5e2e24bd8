from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tablecare.operators.fixes import Fix, apply_fixes
from tablecare.operators.provenance import Trail
from tablecare.operators.rows import dedupe_encounters, dedupe_rows, keep_one

MESSY = [
    ("1", "N/A", "red, blue", "2024-01-01"), ("1", "N/A", "red, blue", "2024-01-01"), ("2", "$1,200", "red", "2024-02-01"), ("2 ", "5", "; green", "2024-03-01"),
    (None, "7", None, None), (None, "7", None, None), ("3", "N/A", "", "2024-01-05"),
]
CHAIN = [Fix("blank_markers", "Dose"), Fix("number_text", "Dose"), Fix("dedupe_rows"), Fix("keep_one", "MRN", {"policy": "last::Day"}), Fix("split_rows", "Tags")]


def test_kept_removed_and_log_come_from_one_table(frame, rows):
    fixed = apply_fixes(frame("MRN, Dose, Tags, Day", MESSY), CHAIN, "row_id")
    assert rows(fixed.rows, "row_id", "Dose", "Tags") == [(0, None, "blue"), (0, None, "red"), (3, "5", "green"), (4, "7", None), (6, None, None)]
    assert rows(fixed.removed, "row_id", "removed_by") == [(1, "dedupe_rows"), (2, "keep_one(MRN)"), (5, "dedupe_rows")]
    log = {r["step"]: tuple(r)[1:] for r in fixed.log.collect()}
    assert log == {
        0: ("blank_markers(Dose)", 3, 7, 7), 1: ("number_text(Dose)", 1, 7, 7), 2: ("dedupe_rows", 0, 7, 5), 3: ("keep_one(MRN)", 0, 5, 4),
        4: ("split_rows(Tags)", 0, 4, 5),
    }


def test_the_chain_runs_once_whatever_the_number_of_steps(spark, frame):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = frame("MRN, Dose, Tags, Day", MESSY)
    fixed = apply_fixes(df.mapInArrow(counted, df.schema), CHAIN, "row_id")
    fixed.rows.collect(), fixed.removed.collect(), fixed.log.collect()
    assert read.value == len(MESSY)


def test_removed_rows_read_the_input_once(spark, frame):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = frame("MRN, Dose, Tags, Day", MESSY)
    assert dedupe_rows(df.mapInArrow(counted, df.schema), "row_id").removed.count() == 2
    assert read.value == len(MESSY)


@pytest.mark.parametrize("how", ["rows", "encounters", "first", "complete", "lastrow"])
def test_marks_agree_with_kept_rows_where_one_group_has_most_rows(spark, rows, how):
    rng = random.Random(how)
    data = [(i, rng.choice(["hot"] * 8 + ["a", "b", None, " "]), rng.choice(["2024-01-01", "2024-02-01", None]), rng.choice(["x", "y", None])) for i in range(3000)]
    df = spark.createDataFrame(data, "row_id long, id string, day string, note string").repartition(7)
    split = {
        "rows": lambda: dedupe_rows(df, "row_id"), "encounters": lambda: dedupe_encounters(df, "id", "row_id"), "first": lambda: keep_one(df, "id", "first::day", "row_id"),
        "complete": lambda: keep_one(df, "id", "complete", "row_id"), "lastrow": lambda: keep_one(df, "id", "lastrow", "row_id"),
    }[how]()
    kept = rows(split.kept)
    assert kept == rows(split.marked.filter("__kept").drop("__kept"))
    assert sorted(kept + rows(split.removed), key=repr) == rows(df)


def test_null_and_shifted_cells_are_different_content(frame, rows):
    df = frame("a, b, c", [("x", None, "y"), (None, "x", "y"), ("x", "y", None), ("x", None, "y")])
    assert rows(dedupe_rows(df, "row_id").removed, "row_id") == [(3,)]


def test_a_trail_remembers_a_column_and_counts_born_rows(frame, rows):
    trail = Trail(frame("id, tags", [("1", "a, b"), ("1", "a, b"), ("2", "c")]), "row_id")
    at = trail.split("split", "tags")
    name = trail.remember("tags")
    trail.cell("upper", "tags", F.upper)
    trail.copies("copies")
    done = trail.store()
    assert [tuple(r) for r in done.steps().select("cells_changed", "rows_before", "rows_after").collect()] == [(0, 3, 5), (3, 5, 5), (0, 5, 3)]
    assert rows(done.after(at), "row_id", name) == [(0, "a"), (0, "b"), (1, "a"), (1, "b"), (2, "c")]
    assert rows(done.rows, "row_id", "tags") == [(0, "A"), (0, "B"), (2, "C")]
    empty = Trail(frame("id", []), "row_id").store()
    assert empty.rows.count() == 0 and empty.removed.columns == ["row_id", "id", "removed_by"] and empty.steps().count() == 0
