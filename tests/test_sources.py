from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablecare.operators.conditions import keep_defined
from tablecare.sources import rules, tables, text


def test_delimited_text_is_never_guessed(spark, tmp_path):
    (tmp_path / "a.csv").write_text('WBC,Diagnosis,Notes,Count\n<0.5,UTI,3/6/2024,"1,204"\n12, flu ,pending,\n,,,\n7,,x,5\n')
    raw = text.read_delimited(spark, str(tmp_path / "a.csv"))
    got = [tuple(r) for r in text.load_text(spark, str(tmp_path / "a.csv")).orderBy("_row").drop("_row").collect()]
    assert got == [("<0.5", "UTI", "3/6/2024", "1204"), ("12", "flu", "pending", None), ("7", None, "x", "5")]
    assert text.blank_row_count(text.normalise(raw)).first()[0] == 1 and set(t for _, t in raw.drop("_row").dtypes) == {"string"}


def test_headers_are_made_unique(spark, tmp_path):
    (tmp_path / "b.tsv").write_text("Name\tName\t\tName (2)\n1\t2\t3\t4\n")
    assert text.read_delimited(spark, str(tmp_path / "b.tsv")).columns == ["Name", "Name (2)", "Column C", "Name (2) (2)", "_row"]
    (tmp_path / "empty.csv").write_text("")
    with pytest.raises(ValueError, match="no data found"):
        text.read_delimited(spark, str(tmp_path / "empty.csv"))


def test_files_with_other_headers_are_refused(spark, tmp_path):
    for folder, header in (("plain", "b,a"), ("odd", "b,a,a")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "1.csv").write_text(("a,b\n" if folder == "plain" else "a,a,b\n") + "1,2,3\n")
        (tmp_path / folder / "2.csv").write_text(header + "\n3,4,5\n")
        with pytest.raises(Exception, match="(?i)header"):
            text.read_delimited(spark, str(tmp_path / folder)).collect()


def test_row_sorts_in_file_order_over_many_splits(spark, tmp_path):
    for name, start in (("1 ä.csv", 0), ("2%20.csv", 4000)):
        (tmp_path / name).write_text("v\n" + "".join(f"{i}\n" for i in range(start, start + 4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        got = [int(r["v"]) for r in text.read_delimited(spark, str(tmp_path)).orderBy("_row").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(8000))


def test_temporal_columns_become_iso_text(spark):
    df = spark.sql("SELECT timestamp'2024-03-05 00:00:00' AS a, timestamp'2024-03-05 10:30:15' AS b, date'2024-01-02' AS c, 5 AS n, ' x ' AS s")
    assert tuple(text.normalise(df).first()) == ("2024-03-05", "2024-03-05 10:30", "2024-01-02", 5, "x")


def test_text_out_and_several_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,a\n2,b\n")
    loaded = text.load_tables(spark, {"one": str(tmp_path / "a.csv"), "two": str(tmp_path / "a.csv")})
    text.write_delimited(loaded["one"], str(tmp_path / "out"))
    assert text.load_text(spark, str(tmp_path / "out")).columns == ["x", "y", "_row"]
    paths = tables.write_tables({"a/b": loaded["one"], "a b": loaded["two"]}, str(tmp_path / "set"), {"a/b": ["y", "x"]})
    assert spark.read.parquet(paths["a/b"]).columns == ["y", "x"] and paths["a b"].endswith("a b (2)")


def test_described_columns(frame):
    df = frame("a, b", [("x", "1"), ("y", "2"), ("x", None), ("z", "3"), ("w", "4"), ("v", "5")])
    got = {r["column"]: (r["type"], r["samples"]) for r in tables.describe_columns(df, "row_id").collect()}
    assert got == {"a": ("text", ["x", "y", "z", "w"]), "b": ("number", ["1", "2", "3", "4"])}


def test_vocabulary_lists_merge(spark, rows):
    vocab = spark.createDataFrame([("Dx", "UTI"), ("Dx", "UTI"), ("Dx", "flu"), ("Ward", None), ("Ward", "A")], "column string, term string")
    merged = rules.merge_vocabulary(vocab)
    assert rows(merged) == [("Dx", "UTI"), ("Dx", "flu"), ("Ward", "A")]
    assert rows(tables.surviving_vocabulary(merged, ["Ward", "Age"])) == [("Ward", "A")]


def test_definitions(frame, rows):
    sheet = frame("Values that count string, Term string, Column it applies to string".replace("Values that count", "`Values that count`").replace(
        "Column it applies to", "`Column it applies to`"), [
        ("cephalexin", "oral beta-lactam", "drug"), ("> 7 when diagnosis = UTI", "excess duration", "Duration days"),
        ("cephalexin; amoxicillin", "Oral Beta Lactams", "drug"), ("x", " ", "drug"),
    ])
    parsed = rules.parse_definitions(sheet, "row_id")
    assert rows(parsed, "key", "rule.kind") == [("excessduration", "threshold"), ("oralbetalactam", "values")]
    df = frame("Drug, Duration_days, Diagnosis", [("Cephalexin", "9", "uti"), ("amoxicillin", "9", "flu"), ("cipro", "8", "UTI")])
    defs = rules.load_definitions(parsed, df.columns)
    assert rows(keep_defined(df, defs, "oral beta lactam"), "row_id") == [(0,), (1,)]
    assert rows(keep_defined(df, defs, "excess durations"), "row_id") == [(0,), (2,)]
    with pytest.raises(KeyError):
        keep_defined(df, defs, "unknown")
    store = rules.parse_definitions(frame("term, column, rule", [("excess duration", "Duration_days", "> 3")]), "row_id")
    merged = rules.merge_definitions(parsed, store)
    assert rows(merged.filter(F.col("key") == "excessduration"), "rule.value", "rule.when_column") == [(3.0, None)] and merged.count() == 2
