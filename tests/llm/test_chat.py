from __future__ import annotations

import hashlib
import itertools
import json

import pytest
from pyspark.sql import functions as F

from tablecare.llm import chat

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<~s>", "[~~/INST]", "<", "[", "~", "s>", "\n", " ", "ö", "\\", "$1"]


def formatted(df):
    return chat.format_turns(chat.canonical_turns(df)).select(
        "*", chat.read_turns(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("trained")
    )


def test_turns_and_loss_come_back_from_the_string(spark):
    texts = ["".join(p) for p in itertools.product(CONTROLS, repeat=2)] + ["", "x" * 20000]
    rows = [(i % 40, i, ["user", "assistant", "</s>", "system"][i % 4], t) for i, t in enumerate(texts)]
    done = {r["conv_id"]: r for r in formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in range(40):
        own = [r for r in rows if r[0] == conv]
        assert [(t["role"], t["text"]) for t in done[conv]["back"]] == [r[2:] for r in own]
        assert done[conv]["trained"] == "".join(r[3] for r in own if r[2] == "assistant")
        for turn, part in zip(own, done[conv]["formatted"].split("</s>\n")):
            assert not any(c in part.replace("<s>[INST] ", "", 1).replace(" [/INST]\n", "", 1) for c in chat.TEMPLATE.controls), turn


def test_nulls_ties_repeats_and_extra_columns(spark):
    rows = [
        (1, 2, "assistant", None, "x"), (1, None, None, "first", "y"), (1, 2, "assistant", "b", "z"), (1, 2, "assistant", "b", "z"),
        (None, 1, "user", "lost", "w"), (None, 2, "user", "too", "w"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, turns string")
    done = {r["conv_id"]: [(t["role"], t["text"]) for t in r["back"]] for r in formatted(df).collect()}
    assert done == {
        1: [("", "first"), ("assistant", ""), ("assistant", "b"), ("assistant", "b")], None: [("user", "lost"), ("user", "too")],
    }
    assert formatted(df.limit(0)).count() == 0


@pytest.mark.parametrize("record, layout, turns", [
    ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, "message list", [("user", "a"), ("assistant", "")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "id": 1}, "speaker list", [("user", "a"), ("assistant", "b")]),
    ({"prompt": "a", "response": "b", "noise": {"x": [1]}}, "prompt response", [("user", "a"), ("assistant", "b")]),
    ({"system": "s", "prompt": "a", "response": "b"}, "system prompt response", [("system", "s"), ("user", "a"), ("assistant", "b")]),
    ({"instruction": "i", "input": "a", "output": "b"}, "instruction input output", [("system", "i"), ("user", "a"), ("assistant", "b")]),
    ({"instruction": "i", "output": "b"}, "instruction output", [("user", "i"), ("assistant", "b")]),
    ({"data": {"prompt": "a", "response": "b"}}, "nested example", [("user", "a"), ("assistant", "b")]),
    ({"other": 1}, None, None),
])
def test_records_of_mixed_layouts(spark, record, layout, turns):
    df = spark.createDataFrame([(json.dumps(record), "kept")], "record string, layout string")
    row = chat.canonical_records(df, "record").head()
    assert row["layout"] == layout
    assert (row["turns"] and [(t["role"], t["text"]) for t in row["turns"]]) == turns


def test_bad_records_and_typed_tables(spark):
    df = spark.createDataFrame([(None,), ("",), ("no json",), ("[]",)], "record string")
    assert [r["turns"] for r in chat.canonical_records(df, "record").collect()] == [None] * 4
    typed = spark.sql("SELECT 7 AS id, 'a' AS prompt, CAST(NULL AS STRING) AS response, named_struct('prompt', 'x') AS data")
    assert chat.layout_of(typed).name == "prompt response"
    assert [tuple(t) for t in chat.canonical_turns(typed).head()["turns"]] == [("user", "a"), ("assistant", "")]
    listed = spark.sql("SELECT array(named_struct('role', 'user', 'content', 'q', 'name', 'n')) AS messages")
    assert [tuple(t) for t in chat.canonical_turns(listed).head()["turns"]] == [("user", "q")]
    with pytest.raises(ValueError):
        chat.layout_of(spark.range(1))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    plan = formatted(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_digest_of_the_contract_turn(spark):
    from tablecare.llm.queries import op1_chat_formatting

    row = {r["conv_id"]: r for r in op1_chat_formatting(spark, "/root/testdata/sf0.001").collect()}[-1]
    text = "</s>[INST] ok [/INST]"
    assert row["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())


def test_paths_of_records_of_any_depth(spark):
    def plain(value, prefix=""):
        out = []
        if isinstance(value, dict):
            for k, v in value.items():
                path = f"{prefix}.{k}" if prefix else k
                out += [path, *plain(v, path)]
        if isinstance(value, list):
            for v in value:
                out += plain(v, prefix + "[]")
        return out

    records = [
        {"a": 1, "b": {"c": {"d": {"e": {"f": [{"g": {"h": "x: {[\"y"}}, 3, {"i": None}]}}}}}, {"m": [{"role": "user", "content": "a } b ] c"}, {"role": "x"}], "n": "{\"q\": 1}"},
        {}, {"x": [[{"y": 1}], []], "z": "back\\slash\""},
    ]
    for record in records:
        df = spark.createDataFrame([(json.dumps(record),), (json.dumps(record, indent=2),)], "r string")
        for r in df.select(chat.record_paths(F.col("r")).alias("p")).collect():
            assert r["p"] == list(dict.fromkeys(plain(record)))
    assert spark.createDataFrame([(None,)], "r string").select(chat.record_paths(F.col("r")).alias("p")).first()["p"] == []
