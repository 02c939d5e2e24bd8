from __future__ import annotations

import random
from collections import Counter

from tablecare.llm.sharding import interleave


def run(spark, rows, shards=8):
    df = spark.createDataFrame(rows, "doc_id long, source string, shard string").repartition(5)
    return [tuple(r) for r in interleave(df.drop("shard"), "doc_id", "source", shards, "s").collect()]


def test_counts_slots_and_mixture(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["hot"] * 6 + ["a", "b", "c", None]), "") for i in range(1003)]
    got = run(spark, rows)
    assert Counter((d, s) for d, s, _, _ in got) == Counter((d, s) for d, s, _ in rows)
    sizes = Counter(x[2] for x in got)
    assert set(sizes) == set(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(8):
        assert sorted(x[3] for x in got if x[2] == shard) == list(range(sizes[shard]))
    of_source = Counter(s for _, s, _ in rows)
    shares = Counter((s, shard) for _, s, shard, _ in got)
    for s, n in of_source.items():
        assert all(abs(shares[s, shard] - n / 8) <= 2 for shard in range(8)), s
    assert sorted(got, key=repr) == sorted(run(spark, rows[::-1]), key=repr)


def test_nulls_repeats_few_rows_and_empty_tables(spark):
    rows = [(None, None, ""), (None, None, ""), (1, "a", ""), (1, "a", ""), (1, "b", "")]
    got = run(spark, rows)
    assert Counter(x[:2] for x in got) == Counter((r[0], r[1]) for r in rows)
    assert len({x[2] for x in got}) == 5 and {x[3] for x in got} == {0}
    assert run(spark, []) == []


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, source string")
    plan = interleave(df, "doc_id", "source", 8)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
