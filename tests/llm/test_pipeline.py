from __future__ import annotations

import os

import numpy as np
import pytest

import corpus_pipeline
from tablecare.llm import langid
from tests.llm.test_decontaminate import plain_words
from tests.llm.test_simhash import plain_split

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain_shingles(text):
    words = plain_split(text)
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))} if words else set()


def plain_pipeline(spark, rows, items):
    """The five stages one after the other in plain Python; the model is the one learned."""
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))
    kept = []
    for r in rows:
        if langid.has_letter(r[1]):
            p = model.probabilities(np.array([langid.bucket_counts(r[1])]))
            if p.max() >= model.threshold:
                kept.append(r)
    seen, docs = set(), []
    for r in sorted(kept):
        lines = r[1].split("\n")
        counted = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for j in range(len(counted) - 2):
            window = tuple(lines[i].strip() for i in counted[j : j + 3])
            if window in seen:
                gone.update(counted[j : j + 3])
            seen.add(window)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip():
            docs.append((r[0], text, r[2], r[3], len(text)))
    shingles = [plain_shingles(r[1]) for r in docs]
    group = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if len(shingles[i] & shingles[j]) >= 0.8 * len(shingles[i] | shingles[j]):
                group = [group[j] if g == group[i] else g for g in group]
    first = {}
    for r, g in zip(docs, group):
        first.setdefault(g, r)
    windows = {}
    for _, text in items:
        words = plain_words(text)
        n = min(10, len(words))
        if n:
            windows.setdefault(n, set()).update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    clean = []
    for r in first.values():
        words = plain_words(r[1])
        if not any(tuple(words[i : i + n]) in w for n, w in windows.items() for i in range(len(words) - n + 1)):
            clean.append(r)
    return sorted(clean)


def written(spark, tmp_path, rows, items):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")
def test_against_plain_python(spark, tmp_path):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select(COLUMNS).collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    n = len(rows)
    rows += [
        (9000, rows[3][1], "en", "s", 0), (9001, rows[5][1] + " extra", "en", "s", 0), (9002, "12 34 !!", "en", "s", 0), (9003, "", "en", None, 0),
        (9004, rows[7][1].split("\n")[0] + " " + items[2][1], "en", "s", 0), (9005, "\n".join(rows[n // 2][1].split("\n")[:5]), None, "s", 0),
    ]
    got = corpus_pipeline.run(spark, written(spark, tmp_path, rows, items)).collect()
    wanted = plain_pipeline(spark, rows, items)
    assert sorted(r["doc_id"] for r in got) == [r[0] for r in wanted]
    ids = {r["doc_id"]: r["ids"] for r in got}
    for key, text, *_ in wanted:
        assert list(np.frombuffer(ids[key], "<u4")) == library.encode(text, add_special_tokens=False).ids


def test_nulls_repeats_and_empty_tables(spark, tmp_path):
    words = "some words of a text that is long enough to learn from and stands here "
    rows = [(i, words + f"number {i} with its own tail {i * 7919} and {i * 104729} more", "en", None, 5) for i in range(30)]
    rows += [(None, "a text without an id but with words", None, None, None), (50, None, None, None, None), rows[0], rows[0]]
    folder = written(spark, tmp_path, rows, [(None, None), (1, "")])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, folder)
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0 and empty.columns == done.columns
        if name != "tokens":
            assert done.columns == COLUMNS
        docs = done
    kept = [r["doc_id"] for r in docs.collect()]
    assert len(kept) == len(set(kept)) and None in kept and 50 not in kept


def test_the_last_stage_decodes_what_it_encoded(spark, tmp_path):
    import hashlib

    library = pytest.importorskip("tokenizers").Tokenizer.from_file(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))
    rows = [(1, "Some words, twice: some words!", "en", "s", 0), (2, "", "en", "s", 0), (3, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).collect():
        decoded = " ".join(map(library.id_to_token, np.frombuffer(r["ids"], "<u4").tolist()))
        assert r["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
