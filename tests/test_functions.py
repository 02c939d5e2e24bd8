from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tablecare.functions import dates, formats, masking, names, numbers, rules, text, units, words


@pytest.fixture
def apply(spark):
    def run(expression, values, kind="string"):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        return [r[0] for r in df.orderBy("i").select(expression(F.col("v")).alias("out")).collect()]

    return run


def test_fold_key_collapses_all_white_space(apply):
    nbsp = chr(0xA0)
    assert apply(text.fold_key, ["  West \t Wing" + nbsp, "WEST WING", None]) == ["west wing", "west wing", None]


def test_missing_and_blank_are_two_notions(apply):
    cells = [None, "", "  ", "N/A", " none ", "-", ".", "<0.5", "0"]
    assert apply(text.is_missing, cells) == [True] * 7 + [False] * 2
    assert apply(text.is_blank, cells) == [True] * 3 + [False] * 6


@pytest.mark.parametrize("cell, number", [
    ("$1,200", 1200.0), (" 5 ", 5.0), ("5 Days", 5.0), ("5mg.", 5.0), ("-0.75", -0.75), ("abc", None), ("<0.5", None),
    ("12-14", None), ("1e3", None), ("N/A", None), ("", None), (None, None), ("1,200 mg", None), ("007", 7.0),
])
def test_to_number(apply, cell, number):
    assert apply(numbers.to_number, [cell]) == [number]


def test_number_text_keeps_what_is_no_number(apply):
    assert apply(numbers.number_text, ["$1,200", " 5 ", "abc", None]) == ["1200", "5", "abc", None]


def test_censored_policies(apply):
    cells = ["<0.5", ">= 10", "pending", "ND", "7", "</= 10", None]
    assert apply(lambda c: numbers.censored(c, "boundary"), cells) == ["0.5", "10", "pending", "ND", "7", "</= 10", None]
    assert apply(lambda c: numbers.censored(c, "missing"), cells) == [None, None, None, None, "7", "</= 10", None]
    assert apply(lambda c: numbers.censored(c, "exclude"), cells) == cells


def test_strip_unit_and_epoch(apply):
    assert apply(numbers.strip_unit, ["5 Days", "365 Days", "N/A", "5Days"]) == ["5", "365", "N/A", "5Days"]
    assert apply(numbers.epoch_serial, ["1899-12-30", "1900-01-06", "2024-01-06", "8"]) == ["0", "7", "2024-01-06", "8"]


@pytest.mark.parametrize("cell, order, iso", [
    ("25/03/2024", "MDY", "25/03/2024"), ("25/03/2024", "DMY", "2024-03-25"), ("2/30/2024", "MDY", "2/30/2024"),
    ("13-05-2024", "DMY", "2024-05-13"), ("2024-03-15", "MDY", "2024-03-15"), ("3/6/2024", "MDY", "2024-03-06"),
    ("01/02/2024, 03/04/2024", "MDY", "01/02/2024, 03/04/2024"), ("29/2/2023", "DMY", "29/2/2023"),
    ("29/2/2024", "DMY", "2024-02-29"),
])
def test_parse_date(apply, cell, order, iso):
    assert apply(lambda c: dates.parse_date(c, order), [cell]) == [iso]


def test_rounding_is_half_up(apply):
    assert apply(numbers.round2, [-2.125, 2.125, 2.5, None], "double") == [-2.12, 2.13, 2.5, None]
    assert apply(lambda c: numbers.share(c, F.lit(8)), [1, 3, 0], "long") == [12.5, 37.5, 0.0]
    assert apply(lambda c: numbers.share(F.lit(3), c), [0], "long") == [0.0]


def test_period_labels_and_their_order(apply):
    assert apply(lambda c: dates.period_label(c, "quarter"), ["2024-05-01", "2024-12", "May"]) == ["2024-Q2", "2024-Q4", None]
    labels = ["2024-Q1", "2024-Q2", "Q3 2024", "2023-12", "Mar 2024", "2024-03-15", "soon"]
    keys = dict(zip(labels, apply(dates.time_order, labels)))
    assert keys["soon"] is None
    assert keys["2024-Q1"] < keys["2024-Q2"] < keys["Q3 2024"]
    assert keys["2023-12"] < keys["Mar 2024"] < keys["2024-03-15"]


def test_split_list(apply):
    assert apply(text.split_list, ["a, b; c", " , ", None, "x"]) == [["a", "b", "c"], [None], [None], ["x"]]


def test_quantities(apply):
    got = apply(units.parse_quantity, ["more than a week", "over 2 weeks", "three months", "48 hours", "7"])
    assert [(q and (q["days"], q["approximate"])) for q in got] == [(7.0, False), (14.0, False), (90.0, True), (2.0, False), None]
    assert units.column_unit("Duration_days") == "days" and units.column_unit("Holidays") is None
    assert units.column_unit("wait hrs") == "hours" and units.unit_note("LOS") and units.unit_note("Age") is None


def test_report_text(apply):
    assert apply(lambda c: formats.mean_sd(c, F.lit(2.94)), [6.0, None], "double") == ["6 (SD 2.94)", "no readable numbers"]
    assert apply(lambda c: formats.median_iqr(c, F.lit(4.5), F.lit(7.0)), [5.5], "double") == ["5.5 (IQR 4.5–7)"]
    assert apply(lambda c: formats.bar_label(c, F.lit(3600)), [1240], "long") == ["1,240 (34%)"]
    assert apply(formats.p_text, [0.0004, 0.0252, 1.0], "double") == ["< 0.001", "0.025", "1"]
    assert apply(formats.plain_number, [12345678.25, 0.0005, 100.0, -3.5], "double") == ["12345678.25", "0.0005", "100", "-3.5"]


def test_words(apply):
    forms = apply(words.fold_word, ["diagnoses", "drugs", "categories", "boxes", "prescriber", "prescriptions", "glass", "as"])
    assert forms == ["diagnose", "drug", "category", "box", "prescriber", "prescribe", "glass", "as"]
    assert apply(words.fold_spelling, ["paediatric", "oedema", "travelled", "organise"]) == ["pediatric", "edema", "traveled", "organize"]
    assert apply(lambda c: words.edit_distance(c, F.lit("amoxicillin"), 2), ["amoxicilin", "kitten"]) == [1, None]
    assert apply(words.expand_short_form, ["E. Coli", "flu"]) == [["escherichia coli"], []]


@pytest.mark.parametrize("query, value, score", [
    ("escherichia coli", "ESCHERICHIA COLI", 3.0), ("coli", "Escherichia coli", 2.0), ("e coli", "Escherichia coli", 1.0),
    ("drugs", "Drug", 0.5), ("prescription", "Prescriber", None), ("xyz", "Drug", None), ("", "Drug", None),
])
def test_match_score(spark, query, value, score):
    q, v = words.tokens(F.lit(query)), words.tokens(F.lit(value))
    got = spark.range(1).select(words.match_score(q, v, words.fold_words(q), words.fold_words(v))).first()[0]
    assert got == score


def test_rules(apply):
    got = apply(rules.parse_rule, ["> 7 when Diagnosis = pyelonephritis", "a, b or c", ">= 2.5", None])
    assert (got[0]["op"], got[0]["value"], got[0]["when_column"], got[0]["when_value"]) == (">", 7.0, "Diagnosis", "pyelonephritis")
    assert got[1]["values"] == ["a", "b", "c"] and got[2]["when_column"] is None and got[3]["values"] == []
    assert apply(rules.term_key_expr, ["oral beta-lactams", "Excess Durations"]) == ["oralbetalactam", "excessduration"]


def test_names():
    roles = {n: names.id_role(n) for n in ("PAT_ENC_CSN_ID", "Encounter ID", "PatientID", "MRN", "medical record", "Patient", "Visit no")}
    assert list(roles.values()) == ["encounter", "encounter", "patient", "patient", "patient", None, None]
    assert names.unique_names(["Name", "Name", "Name (2)", None]) == ["Name", "Name (2)", "Name (2) (2)", "Column D"]
    assert names.match_name("patient id", ["Drug", "Patient_ID"]) == "Patient_ID"
    assert names.column_letter(0) == "A" and names.column_letter(27) == "AB"
    assert names.safe_table_names(["a/b", "a b", "x" * 40]) == ["a b", "a b (2)", "x" * 31]


def test_masks_keep_shape_and_hide_equality(spark):
    seed = F.xxhash64("id")
    df = spark.range(2).select(*[
        masking.mask_string(F.lit(v), seed).alias(n)
        for n, v in {"name": "Dr. Smith", "code": "MRN-00042", "day": "2024-03-05", "time": "2024-03-05 10:30"}.items()
    ], masking.mask_number_text(F.lit("-10.75"), seed).alias("number"))
    first, second = df.collect()
    assert re.fullmatch(r"[A-Z][a-z]\. [A-Z][a-z]{4}", first["name"]) and first["name"] != second["name"]
    assert re.fullmatch(r"[A-Z]{3}-\d{5}", first["code"]) and re.fullmatch(r"20[01]\d-[01]\d-[0-2]\d", first["day"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\d \d\d:\d\d", first["time"]) and re.fullmatch(r"-[1-9]\d\.\d\d", first["number"])
    assert df.collect()[0] == first
