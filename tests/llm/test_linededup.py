from __future__ import annotations

import random

from tablecare.llm import linededup as d


def brute(rows):
    """Sequential over rows in key order."""
    seen, out = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text in order:
        lines = (text or "").split("\n") if text is not None else []
        counted = [i for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for j in range(len(counted) - 2):
            window = tuple(lines[i].strip() for i in counted[j : j + 3])
            if window in seen:
                gone.update(counted[j : j + 3])
            seen.setdefault(window, key)
        out[key] = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "old") for r in rows], "doc_id long, text string, removed string").repartition(4)
    return d.drop_repeated_lines(df).collect()


def test_against_a_sequential_pass(spark):
    rng = random.Random(2)
    for lines in (["a", "b", " c "], ["a", "b", "c", "d", "e", "f", "g", "", "  ", "c\r"]):
        rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(0, 12)))) for i in range(60)]
        rows += [(100, None), (101, ""), (None, "a\nb\nd"), (102, "\n".join(str(i) for i in range(5000)) + "\na\nb\nd")]
        rows += [(103, "q\nr\ns"), (104, "q\nr\ns"), (104, "q\nr\ns")]
        got = {}
        for r in run(spark, rows):
            value = r["text"], r["n_lines"], r["n_removed"]
            assert got.setdefault(r["doc_id"], value) == value
            assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"])
        assert got == brute(rows)
        assert len(run(spark, rows)) == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert d.drop_repeated_lines(df).count() == 0
    assert d.drop_repeated_lines(df).columns == ["doc_id", "text", "n_lines", "n_removed", "removed"]


def test_covers_merge():
    assert d.without("a\nb\n\nc\nd\ne", [0, 1]) == ("\ne", [(0, 2), (3, 5)])
