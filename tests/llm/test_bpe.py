from __future__ import annotations

import random
import unicodedata

import pytest

from tablecare.llm import bpe

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")
PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, texts):
    vocabulary = bpe.vocabulary_at(PATH)
    wanted = library.encode_batch(texts, add_special_tokens=False)
    for text, w, got in zip(texts, wanted, bpe.encode_all(vocabulary, iter(texts))):
        ids = [int.from_bytes(got[i : i + 4], "little") for i in range(0, len(got), 4)]
        assert ids == w.ids, text[:80]
        assert vocabulary.decode(got) == library.decode(w.ids, skip_special_tokens=False)


def test_marks_words_and_spaces(library):
    same(library, [
        "", " ", "a", "<|endoftext|> x <|startoftext|>y<|ENDOFTEXT|>", "I'm we'LL 's ''s don't", "ΑΣ ΑΣΑ Σ İx", "é É", "a\x1cb\x85c d　e\xa0f\tg\r\nh",
        "12 3½²", "日本語テキスト", "​ab", " lead  two\n\nlines\t", "x.y, z;;;!!! (ab)", "ñandú Über STRASSE ß",
    ])


def test_long_words_and_random_strings(library):
    rng = random.Random(1)
    same(library, ["".join(rng.choices("etaoinsh", k=rng.randint(1, 200))) for _ in range(400)])
    same(library, ["".join(rng.choices("aeéß.'<|> \n1日", k=rng.randint(0, 60))) for _ in range(400)])
    same(library, ["ab" * 3000, "z" * 5000 + " end"])


def test_every_assigned_character(library):
    texts = [f"a{chr(c)}b {chr(c)}" for c in range(0x30000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) not in ("Cn", "Co")]
    same(library, texts)


def test_texts_longer_than_a_slice(library, monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 50)
    monkeypatch.setattr(bpe, "CACHED", 10)
    rng = random.Random(2)
    same(library, [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 9))) for _ in range(n)) for n in (0, 3, 40, 500, 1)])
    assert " ".join(bpe.slices("aa bb " * 100, 20)) == "aa bb " * 100


def test_table_with_nulls_repeats_and_clashing_columns(spark, library):
    rows = [(1, "Some text.", "x"), (1, "Some text.", "x"), (2, None, "y"), (None, "", "z"), (3, "word " * 60_000, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    done = bpe.round_trip(df, PATH)
    assert done.columns == ["doc_id", "n_tokens", "ids", "decoded"]
    got = sorted([(r["doc_id"], r["n_tokens"], r["decoded"]) for r in done.collect()], key=repr)
    wanted = [library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows]
    assert got == sorted([(r[0], len(w), library.decode(w, skip_special_tokens=False)) for r, w in zip(rows, wanted)], key=repr)
    assert bpe.round_trip(df.limit(0), PATH).count() == 0
