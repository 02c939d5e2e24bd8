from __future__ import annotations

import random
import re

import numpy as np
import pytest

from tablecare.llm import decontaminate as d


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def brute(docs, items, window=10):
    out = []
    for key, text in docs:
        words = plain_words(text)
        hit, found = set(), set()
        for item, said in items:
            own = plain_words(said)
            n = min(window, len(own))
            wanted = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
            for i in range(len(words) - n + 1):
                if n and tuple(words[i : i + n]) in wanted:
                    hit.update(range(i, i + n))
                    found |= {str(item)} if item is not None else set()
        out.append((key, len(words), len(hit), ",".join(sorted(found))))
    return sorted(out, key=repr)


def run(spark, docs, items, block_bytes=d.BLOCK_BYTES):
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = d.find_windows(df, bench, keep=["doc_id"], block_bytes=block_bytes).collect()
    return sorted([(r[0], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), ",".join(r["items"])) for r in rows], key=repr)


@pytest.mark.parametrize("block_bytes", [d.BLOCK_BYTES, 200])
def test_against_every_window_of_every_item(spark, block_bytes):
    rng = random.Random(5)
    vocabulary = ["a", "b", "É", "c1", "ü", "The"]
    items = [(i % 9, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 9, 10, 11, 14])))) for i in range(12)]
    items += [(None, "null item b b b b c1 a a a"), (50, None), (51, "!!"), (52, items[0][1])]
    docs = [(i, "; ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(30)]
    docs += [(i, f"x {items[i % 12][1].upper()} y") for i in range(10)]
    docs += [(None, "null " + items[3][1]), (100, None), (101, ""), (5, "same"), (5, "same"), (102, "q " * 30000 + items[4][1])]
    assert run(spark, docs, items, block_bytes) == brute(docs, items)


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "mine", 3)], "doc_id long, text string, items string, n_words int")
    none = spark.createDataFrame([], "item_id long, text string")
    row = d.find_windows(docs, none).collect()
    assert [(r["doc_id"], r["text"], r["n_words"], r["spans"], r["items"]) for r in row] == [(1, "a b", 2, [], [])]
    assert d.find_windows(docs.limit(0), none).count() == 0


def test_the_scan_jumps():
    patterns = np.array([[1, 2, 3, 4, 5, 6, 7, 8, 9, 10]])
    matcher = d.Matcher(patterns)
    text = np.zeros(100_000, np.int64)
    text[5000:5010] = patterns[0]
    text[-10:] = patterns[0]
    looked = []
    hashed = matcher._hash
    matcher._hash = lambda a, b: looked.append(len(b)) or hashed(a, b)
    starts, numbers = matcher.search(text)
    assert sorted(starts.tolist()) == [5000, 99_990] and numbers.tolist() == [0, 0]
    assert sum(looked) < len(text) / 8


def test_blocks_are_searched_one_after_the_other(spark, monkeypatch):
    alive, most = set(), []
    real = spark.sparkContext.broadcast

    class Kept:
        def __init__(self, shared):
            self.shared = shared
            alive.add(id(self))
            most.append(len(alive))

        def __getattr__(self, name):
            return getattr(self.shared, name)

        def __reduce__(self):
            return self.shared.__reduce__()

        def destroy(self):
            alive.discard(id(self))
            self.shared.destroy()

    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: Kept(real(value)))
    words = [f"w{i}" for i in range(400)]
    items = spark.createDataFrame([(i, " ".join(words[i * 10 : i * 10 + 12])) for i in range(38)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words[i * 7 : i * 7 + 60]), "x") for i in range(45)], "doc_id long, text string, spans string")
    whole = {r["doc_id"]: tuple(r) for r in d.find_windows(docs, items, keep=["doc_id"]).collect()}
    most.clear(), alive.clear()
    blocks = {r["doc_id"]: tuple(r) for r in d.find_windows(docs, items, keep=["doc_id"], block_bytes=400).collect()}
    assert blocks == whole and len(most) >= 4 and max(most) == 1
