from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablecare.operators import fixes, profile, quality
from tablecare.operators.fixes import Fix

ENCOUNTERS = [
    ("P1", "UTI", "cephalexin", "10", "2024-01-02", "12.4"), ("P2", "pneumonia", "amoxicillin", "7", "2024-01-05", "<0.5"),
    ("P3", "UTI", "cefpodoxime", "5", "1/9/2024", "9.8"), ("P4", "cystitis", "amoxicillin", "N/A", "2024-02-01", "N/A"),
    ("P4", "cystitis", "amoxicillin", "N/A", "2024-02-01", "N/A"), ("P5", "pneumonia", "cephalexin", "5", "2024-03-01", "15.1"),
]


@pytest.fixture
def encounters(frame):
    return frame("PatientID, Diagnosis, Drug, Duration_days, Visit_date, Lab_value", ENCOUNTERS)


def found(df, **options):
    return {(r["type"], r["column"]): r for r in quality.scan(df, "t", "row_id", **options).collect()}


def test_scan_of_a_messy_table(encounters):
    got = found(encounters)
    assert got[("duplicateRows", None)]["count"] == 1
    assert got[("missing", "Duration_days")]["count"] == 2 and got[("missing", "Duration_days")]["fix"] == "blank_markers"
    assert got[("textDates", "Visit_date")]["param"] == "order?" and got[("censored", "Lab_value")]["count"] == 1
    assert ("duplicatePatientIds", "PatientID") not in got  # P4 is only an exact copy
    assert not any(kind == "categoryVariants" for kind, _ in got)


def test_dates_force_their_order(frame):
    order = lambda cells: found(frame("StartDate", [(c,) for c in cells]))[("textDates", "StartDate")]
    assert order(["25/03/2024", "01/04/2024"])["param"] == "DMY"
    assert order(["03/25/2024", "01/04/2024"])["param"] == "MDY"
    assert order(["03/04/2024", "05/06/2024"])["param"] == "order?"
    assert order(["31/04/2024", "01/04/2024"])["detail"] == "1 unreadable"


def test_epoch_dates_need_a_numeric_majority(frame):
    assert found(frame("Duration", [("7",), ("5",), ("1899-12-30",), ("1900-01-06",), ("8",)]))[("epochDates", "Duration")]["count"] == 2
    assert ("epochDates", "Duration") not in found(frame("Duration", [("7",), ("1899-12-30",), ("1900-01-06",)]))


def test_a_marker_in_a_closed_category_is_a_value(frame):
    df = frame("PatientID, WBCs", [("1", "</= 10"), ("2", "> 10"), ("3", "N/A"), ("4", "</= 10"), ("5", "N/A")])
    got = found(df)
    assert ("missing", "WBCs") not in got and got[("censored", "WBCs")]["count"] == 3
    assert found(frame("x", [("3",), ("5",), ("N/A",)]))[("missing", "x")]["count"] == 1


def test_encounters_and_patients(frame):
    df = frame("CSN, MRN, Ward", [
        ("1001", "M1", "A"), ("1001", "M1", "A"), ("1002", "M1", "B"), ("1003", "M2", "A"), ("1003", "M2", "C"), (None, None, "A"),
    ])
    got = found(df)
    assert (got[("duplicateEncounterIds", "CSN")]["count"], got[("duplicateEncounterIds", "CSN")]["detail"]) == (2, "1 copies, 1 differing")
    assert got[("duplicatePatientIds", "MRN")]["count"] == 2 and "complete" in got[("duplicatePatientIds", "MRN")]["detail"]
    shown = quality.differing_rows(df, "CSN", ["CSN", "MRN", "Ward"], "row_id")
    assert sorted(r["row_id"] for r in shown.collect()) == [3, 4]


def test_ids_variants_lists_units(frame):
    df = frame("code, Sex, organisms, dose, note", [
        (f"c{i}" if i != 19 else "c18", "Male" if i < 10 else "male" if i < 15 else "F", "E. coli, MRSA" if i < 2 else "MRSA",
         f"{i} mg" if i % 2 else f"{i} kg", f"{i} tabs") for i in range(20)
    ])
    got = found(df)
    assert got[("duplicateIds", "code")]["count"] == 1 and got[("categoryVariants", "Sex")]["count"] == 1
    assert got[("multiValue", "organisms")]["count"] == 2 and got[("mixedUnits", "dose")]["detail"] == "kg, mg"
    assert ("unitSuffixNumbers", "dose") not in got and got[("unitSuffixNumbers", "note")]["detail"] == "tabs"


def test_impossible_values(spark):
    df = spark.createDataFrame(
        [(0, -1.0, 130, "2024-01-01", "2024-02-01"), (1, 2.0, 30, "2024-03-01", "2024-02-01"), (2, 3.0, 131, "2024-01-01", "2999-01-01")],
        "row_id long, `Dose mg` double, Age int, start_date string, end_date string",
    )
    got = quality.scan(df, "t", "row_id", today="2025-01-01", date_columns=["start_date", "end_date"]).filter("type = 'impossible'")
    assert {(r["column"], r["detail"]): r["count"] for r in got.collect()} == {
        ("Dose mg", "negative"): 1, ("Age", "age over 120"): 2, ("end_date", "in the future"): 1, ("end_date", "before start_date"): 1,
    }


def test_vocabulary_and_grain(frame, spark):
    df = frame("Diagnosis, PatientID", [("Pyelonefritis", "a"), ("  cystitis ", "A"), ("Pyelonefritis", "b"), ("cUTI", None)])
    vocab = spark.createDataFrame([("Diagnosis", t) for t in ("cUTI", "Pyelonephritis", "Cystitis")], "column string, term string")
    got = found(df, vocab=vocab, entity="PatientID")
    assert got[("notInPicklist", "Diagnosis")]["count"] == 2
    assert (got[("repeating_entity", "PatientID")]["count"], got[("repeating_entity", "PatientID")]["detail"]) == (2, "3 rows, 2 entities")


def test_entity_column_by_name_or_by_uniqueness(frame):
    df = frame("CSN, Drug", [(str(i // 2 * 2 if i > 17 else i), "x") for i in range(20)])
    values = profile.value_frequencies(df, ["CSN", "Drug"], first=F.col("row_id"))
    facts = quality.column_facts(df, values, ["CSN", "Drug"], "9999")
    assert quality.entity_column(facts, ["CSN", "Drug"], "drugs") == "Drug"
    assert quality.entity_column(facts, ["CSN", "Drug"]) == "CSN"


def test_merge_map_takes_the_most_common_spelling(frame, rows):
    df = frame("Sex", [("Male",), ("Male",), ("male",), ("MALE",), ("F",)])
    values = profile.value_frequencies(df, ["Sex"], first=F.col("row_id"))
    facts = quality.column_facts(df, values, ["Sex"], "9999")
    got = quality.variant_map(values, quality.few_valued(facts))
    assert rows(got, "raw", "canonical") == [("MALE", "Male"), ("Male", "Male"), ("male", "Male")]


def test_fixes_run_in_their_order_and_are_logged(frame):
    df = frame("PatientID, Sex, Result, Dose", [
        ("P1", "M", "<0.5", "$1,200"), ("P1", "M", "<0.5", "1200"), ("P2", "Male", "5", " 5 "), ("P3", "male", "7; 8", "abc"), ("P3", "F", "9", "1,000"),
    ])
    chosen = [
        Fix("split_rows", "Result"), Fix("dedupe_rows"), Fix("number_text", "Dose"), Fix("censored", "Result", {"policy": "boundary"}),
        Fix("merge_spellings", "Sex", {"map": {"male": "Male"}}), Fix("keep_one", "PatientID", {"policy": "firstrow"}),
    ]
    got = fixes.apply_fixes(df, chosen, "row_id")
    assert sorted((r["row_id"], r["Sex"], r["Result"], r["Dose"]) for r in got.rows.collect()) == [
        (0, "M", "0.5", "1200"), (2, "Male", "5", "5"), (3, "Male", "7", "abc"), (3, "Male", "8", "abc"),
    ]
    assert sorted((r["row_id"], r["removed_by"]) for r in got.removed.collect()) == [(1, "dedupe_rows"), (4, "keep_one(PatientID)")]
    log = [tuple(r)[1:] for r in got.log.orderBy("step").collect()]
    assert log == [
        ("number_text(Dose)", 3, 5, 5), ("censored(Result)", 2, 5, 5), ("merge_spellings(Sex)", 1, 5, 5),
        ("dedupe_rows", 0, 5, 4), ("keep_one(PatientID)", 0, 4, 3), ("split_rows(Result)", 0, 3, 4),
    ]
    assert df.count() == 5


def test_requests_select_findings(encounters):
    findings = quality.scan(encounters, "t", "row_id")
    assert {r["column"] for r in fixes.select_findings(findings, "missing").collect()} == {"Duration_days"}
    assert [r["type"] for r in fixes.select_findings(findings, "dates", "visit date").collect()] == ["textDates"]
    assert fixes.select_findings(findings, "missing", "lab value").count() == 0


def test_types_and_profile(frame):
    df = frame("Age, Dx, d, num, e", [
        ("10", "UTI", "2024-01-01", "$1,000", None), ("20", "UTI", "N/A", "2", None), ("30", "pneumonia", "2024-05-01 10:00", "3", None),
        (None, "UTI", None, "4", None), (None, "cystitis", None, "5", None), (None, "pneumonia", None, "6", None),
    ])
    types = {r["column"]: (r["type"], r["is_numeric"]) for r in profile.infer_types(df.drop("row_id")).collect()}
    assert types == {
        "Age": ("number", True), "Dx": ("text", False), "d": ("date", False), "num": ("mixed (text + numbers)", True), "e": ("empty", False),
    }
    got = {r["column"]: r for r in profile.profile(df, "row_id").collect()}
    assert (got["Age"]["filled_pct"], got["Age"]["distinct"], got["Age"]["summary"]) == (50, 3, "10 – 30")
    assert got["Dx"]["summary"] == "UTI (3), pneumonia (2), cystitis (1)" and got["num"]["type"] == "number (stored as text)"
    assert got["e"]["is_empty"] and got["e"]["summary"] == "empty column"
    roles = profile.column_roles(profile.profile(df, "row_id"), ["Age", "Dx", "d", "num", "e"])
    assert [r["column"] for r in profile.role_order(roles, "outcome").collect()][:2] == ["Age", "num"]
    assert {r["column"]: r["suits_axis"] for r in roles.collect()}["Dx"]
    assert profile.profile(df, "row_id", sample_rows=2).filter("column = 'Age'").first()["summary"] == "10 – 20"


def test_columns_of_many_values_give_the_same_findings(frame, rows):
    cells = [(f"P{i % 70}", ["Male", "male", "MALE ", "n/a", "f", None][i % 6], f"{i} mg" if i % 2 else f"${i},000", f"note  {i % 50}" if i % 3 else f"Note {i % 50}") for i in range(210)]
    df = frame("MRN, Sex, Dose, Note", cells + cells[:7])
    few, many = (quality.scan(df, "t", "row_id", category=c) for c in (10**6, 0))
    some = quality.scan(df, "t", "row_id", category=60)
    assert rows(few) == rows(many) == rows(some) and {"categoryVariants", "duplicatePatientIds", "unitSuffixNumbers"} <= {r[2] for r in rows(few)}
    assert quality.many_valued(df, ["MRN", "Sex"], 60) == ["MRN"]


def test_row_and_id_findings_show_examples(frame):
    df = frame("CSN, MRN, Drug", [("1", "a", None), ("2", "b", "x"), ("3", "c", "x"), ("2", "b", "x"), ("1", "a", "y"), ("1", "a", None), ("1", "a", None)])
    found = quality.explained(quality.scan(df, "t", "row_id"), df, "row_id")
    got = {(r["type"], r["column"]): r["samples"] for r in found.collect()}
    assert got["duplicateRows", None] == ["2 · b · x", "1 · a"]
    assert got["duplicateEncounterIds", "CSN"] == ["1 (4×)", "2 (2×)"] and got["duplicatePatientIds", "MRN"] == ["a (2×)"]
