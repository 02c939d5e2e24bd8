from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from tablecare.llm import queries as q
from tablecare.llm import spelling as s


def plain_counts(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts):
    out, words = {}, sorted(counts)
    for w in words:
        near = [x for x in words if one_apart(w, x)]
        best = min(near, key=lambda x: (-counts[x], x), default=None)
        form = best if best and counts[best] >= 2 * counts[w] else None
        out[w] = (form, counts[w], len(near), counts[form] if form else None)
    rows = set()
    for w, (form, n, n_near, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, n_near, form_n))
    return rows


def listed(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("alphabet, sizes", [("ab", (5, 9)), ("abcé", (5, 7)), ("abcdefghijÿ×", (5, 6))])
def test_near_words_against_all_pairs(spark, alphabet, sizes):
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(*sizes))) for _ in range(350)}
    words |= {w[: (i := rng.randrange(len(w)))] + rng.choice(alphabet) + w[i + rng.randint(0, 1) :] for w in sorted(words)}
    counts = {w: rng.choice([3, 4, 8, 20, 100, 700]) for w in words if len(w) >= 5}
    counted = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(4)
    assert listed(s.variants(counted)) == plain_variants(counts)


def test_a_chain_of_forms(spark):
    counts = {"abcdefgh"[:i] + "x" * (8 - i): 3 * 2**i for i in range(9)}
    counted = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = listed(s.variants(counted))
    assert got == plain_variants(counts) and {r[2] for r in got} == {"abcdefgh"}


def test_pivots_do_not_overlap_and_are_the_least():
    rng = random.Random(5)
    for _ in range(300):
        prefix = sorted({(rng.randrange(20), place) for place in rng.sample(range(9), rng.randint(3, 7))})
        a, b = s.pivots_of(prefix)
        assert abs(a[1] - b[1]) >= 2 and {a, b} <= set(prefix)
        assert a[0] + b[0] == min(x[0] + y[0] for x in prefix for y in prefix if y[1] - x[1] >= 2)


ROWS = [
    (1, "Straße straße STRASSE Ärger ärger É Élan élan × a÷b naïve naïve naïve don't"), (None, "Ärger word-word WORD日本word wordy wordy Wordy"), (2, None), (3, ""),
    (4, "wordy " * 500 + "x" * 5000), (5, "wordx " * 3 + "wordys wordys wordys"), (5, "wordx " * 3 + "wordys wordys wordys"), (6, " ".join("colour color".split() * 200)),
]


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_counts_of_whole_texts(spark, monkeypatch, size):
    monkeypatch.setattr(s, "SLICE", size)
    for _, text in ROWS:
        runs = [w.decode("latin-1") for words in s.runs(text or "") for w in words]
        assert runs == ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r) for r in re.findall("[A-Za-zÀ-ÿ]+", text or "")]


def test_words_of_documents(spark):
    rows = ROWS + [(k, "several words in very many documents") for k in range(300)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, word string, n long").repartition(3)
    counted = s.word_counts(docs, edit=q.misspelt)
    assert {r["word"]: r["n"] for r in counted.collect()} == plain_counts(rows)
    assert listed(s.variants(counted)) == plain_variants(plain_counts(rows))
    assert s.variants(s.word_counts(docs.limit(0))).count() == 0


def test_very_long_words(spark):
    long = "x" * 20_000
    counts = {long: 3, long + "x": 9, long[:-1] + "y": 30, "y" + long[1:]: 5}
    counted = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {(len(r["word"]), r["n"]): (r["form_n"], r["n_near"]) for r in s.variants(counted).collect()}
    assert got == {(20_000, 3): (30, 3), (20_001, 9): (None, 1), (20_000, 30): (None, 1), (20_000, 5): (None, 1)}


def test_one_edit():
    rng = random.Random(2)
    words = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 6))) for _ in range(120)]
    assert all(s.one_edit(a, b) == one_apart(a, b) for a in words for b in words)


def test_tables_of_keys_are_not_sent_to_every_task(spark):
    from tablecare.llm.common import stored

    words = stored(spark.createDataFrame([(w, 3) for w in ("colour", "colours", "collour", "flavour")], "word string, n long"))
    near = s.near_pairs(words, s.bigram_ranks(words))
    assert near.count() == 4
    # Spark sizes a table of up to 24 keys a word as one of a key each: 270,000 words would fill a driver.
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    found = s.variants(words)
    assert found.count() == 4
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
