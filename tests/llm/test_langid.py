from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tablecare.llm import langid

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_held_out_accuracy_and_few_rejections(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = langid.predict(docs.drop("lang"), langid.train(docs), ["doc_id"])
    held = found.join(docs.select("doc_id", "lang"), "doc_id").filter(langid.held_out(F.col("doc_id")))
    right, accepted, n = held.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.avg(F.col("accepted").cast("double")), F.count("*")).head()
    assert n > 250 and right > 0.98 and accepted > 0.99


SENTENCES = {
    "en": "the house is on the hill and the river runs below it with a bridge", "de": "das haus steht auf dem hügel und der fluss fließt darunter",
}


def labelled(spark):
    rows = [(i, SENTENCES[k] + f" {i}", k, "x") for i in range(60) for k in SENTENCES] + [(900, "no label", None, "x"), (901, None, "en", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_defined_cases(spark):
    model = langid.train(labelled(spark))
    rows = [
        (1, "the bridge on the river", "z"), (2, "der hügel und das haus", "z"), (3, None, "z"), (4, "", "z"), (5, "123 .. !!", "z"), (None, "the the", "z"),
        (1, "the bridge on the river", "z"), (6, "the river " * 200_000, "z"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string")
    got = langid.predict(df, model, df.columns).collect()
    assert [(r["doc_id"], r["lang_pred"]) for r in got] == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (1, "en"), (6, "en")]
    assert all((r["score"] == 0.0 and not r["accepted"]) if r["lang_pred"] == "und" else 0.5 <= r["score"] <= 1 for r in got)
    assert langid.predict(df.limit(0), model, ["doc_id"]).count() == 0


def test_nothing_to_learn_from(spark):
    none = labelled(spark).filter("lang IS NULL")
    assert langid.train(none) is None and langid.train(none.limit(0)) is None
    assert [r["lang_pred"] for r in langid.predict(none, None, ["doc_id"]).collect()] == ["und"]


def test_training_is_repeatable_and_never_sees_held_out_rows(spark):
    docs = labelled(spark)
    a, b = langid.train(docs), langid.train(docs.repartition(7))
    assert (a.weights == b.weights).all() and a.threshold == b.threshold
    spoiled = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id")), "xx").otherwise(F.col("lang")))
    assert langid.train(spoiled).languages == ["de", "en"]
    assert langid.has_letter("é") and not langid.has_letter("1²٣") and not langid.has_letter(None)


def test_junk_is_rejected_and_both_errors_are_told(spark):
    rows = [(i, SENTENCES[k] + f" {w} {i}", k, "x") for i in range(200) for k in SENTENCES for w in [SENTENCES[k].split()[i % 9]]]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, score string"))
    junk = [(i, langid.shuffled(SENTENCES["en"], i)) for i in range(50)]
    found = langid.predict(spark.createDataFrame(junk, "doc_id long, text string"), model, ["doc_id"]).collect()
    assert sum(r["accepted"] for r in found) < 25
    assert model.threshold > 0.4 and model.lost <= langid.LOST and 0 <= model.passed <= 0.5


def test_every_labelled_row_of_many_blocks_trains(spark):
    ids = spark.range(20_000).withColumn("lang", F.when(F.col("id") % 2 == 0, "en").otherwise("de"))
    said = F.when(F.col("lang") == "en", SENTENCES["en"]).otherwise(SENTENCES["de"])
    docs = ids.select(F.col("id").alias("doc_id"), F.concat_ws(" ", said, F.hex("id")).alias("text"), "lang")
    kept = ~langid.held_out(F.col("doc_id"))
    changed = docs.filter(kept & (F.col("doc_id") > 1000)).agg(F.min("doc_id")).head()[0]
    other = docs.withColumn("text", F.when(F.col("doc_id") == changed, "quite another text").otherwise(F.col("text")))
    a, b = langid.train(docs), langid.train(other)
    assert (a.weights != b.weights).any()
    found = langid.predict(docs, a, ["doc_id", "lang"])
    assert found.filter("lang <> lang_pred").count() == 0 and found.filter("NOT accepted").count() <= 200
    assert (langid.train(docs.repartition(5)).weights == a.weights).all() and a.lost <= langid.LOST
