from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tablecare.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k):
    import numpy as np

    whole = [(i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v, _ in rows if usable(v)]
    out = []
    for n, (q, qv) in enumerate(whole):
        if q is None or q % 5:
            continue
        scored = sorted(
            [(-sum(a * b for a, b in zip(qv, v)), i is None, i or 0) for m, (i, v) in enumerate(whole) if m != n]
        )[:k]
        out += [(q, r + 1, None if absent else i, -s) for r, (s, absent, i) in enumerate(scored)]
    return sorted(out, key=repr)


def run(spark, rows, k=4):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = topk.top_k(df, F.col("vec_id") % 5 == 0, k)
    return sorted([tuple(r) for r in found.select("query_id", "rank", "id", "score").collect()], key=repr)


@pytest.mark.parametrize("batch", [topk.QUERIES, 3])
def test_against_all_pairs(spark, monkeypatch, batch):
    monkeypatch.setattr(topk, "QUERIES", batch)
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], "x") for i in range(90)]
    rows += [(90 + i, rows[i % 7][1], "copy") for i in range(40)]
    rows += [
        (200, None, ""), (205, [1.0, None], ""), (210, [float("nan")] * 8, ""), (215, [float("inf")] * 8, ""), (220, [], ""),
        (225, [0.5, -0.5], "short"), (None, rows[0][1], "no id"), (5, rows[5][1], "again"), (5, rows[6][1], "same id"), (10, rows[10][1], "again"),
    ]
    assert run(spark, rows) == brute(rows, 4)


def test_fewer_candidates_than_k_and_empty_tables(spark):
    assert run(spark, [(0, [1.0, 2.0], ""), (1, [0.5, 0.5], "")]) == [(0, 1, 1, 256 * 128 + 512 * 128)]
    assert run(spark, [(0, [1.0], "")]) == []
    assert run(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [1e6 + i, -3e6, 7e5], "") for i in range(12)]
    assert run(spark, rows) == brute(rows, 4)


def test_bounds_stop_before_the_last_segment():
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-20, 20, (500, 16))
    x[7] = 100
    rows = [(np.nonzero(np.frexp(np.abs(x).astype(float))[1] == b)) for b in range(7, 0, -1)]
    read = []

    class Counted(list):
        def __iter__(self):
            for i, s in enumerate(super().__iter__()):
                read.append(i)
                yield s

    segments = Counted([(d, v, x[v, d]) for v, d in rows])
    members, _ = topk.possible_members(segments, 500, np.full((1, 16), 50), np.array([topk.LOWEST]), 1)
    assert members[0, 7] and members.sum() <= topk.FEW
    assert len(read) < 2 * len(rows)
