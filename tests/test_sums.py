from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tablecare.operators import aggregate, datasets
from tablecare.operators.quantiles import exact_quantiles
from tablecare.operators.sums import exact_sums
from tablecare.plans.question import Measure, answer
from tablecare.plans.report_cards import report_cards


def values_of(kind, rng):
    if kind == "any size":
        return [rng.uniform(-1, 1) * 10.0 ** rng.randint(-280, 280) for _ in range(300)]
    if kind == "cancelling":
        big = [rng.uniform(1, 9) * 1e17 for _ in range(100)]
        return big + [-x for x in big] + [0.1] * 7 + [1e-9]
    if kind == "money":
        return [round(rng.uniform(-1e6, 1e6), 2) for _ in range(500)]
    return [float(rng.randint(-(2**53), 2**53)) for _ in range(300)] + [5e-324, 2.0**-980, 0.0, -0.0]


@pytest.mark.parametrize("kind", ["any size", "cancelling", "money", "whole and tiny"])
def test_sums_are_the_same_bits_in_any_partitioning_and_close_to_exact(spark, kind):
    rng = random.Random(kind)
    values = values_of(kind, rng)
    rows = [(i % 3, x) for i, x in enumerate(values)] + [(1, None), (9, None)]
    found = set()
    for partitions in (1, 2, 5, 8):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "g long, x double").repartition(partitions)
        found.add(tuple(sorted((r["g"], r["sum"]) for r in exact_sums(df, ["g"], "x").collect() if r["g"] != 9)))
        assert exact_sums(df, ["g"], "x").filter("g = 9").first()["sum"] is None
    assert len(found) == 1
    for g, total in found.pop():
        wanted = math.fsum(x for k, x in rows if k == g and x is not None)
        assert total == pytest.approx(wanted, rel=1e-15, abs=2.0**-990)


def test_infinities_and_counts(spark):
    df = spark.createDataFrame([("a", float("inf"), 1), ("b", float("nan"), 1), ("c", 0.1, 10), ("c", -0.3, 3), ("d", 0.0, 5)], "g string, x double, n long")
    got = {r["g"]: r["sum"] for r in exact_sums(df, ["g"], "x", times="n").collect()}
    assert got["a"] == math.inf and math.isnan(got["b"]) and got["d"] == 0.0
    assert got["c"] == math.fsum([0.1] * 10 + [-0.3] * 3)
    assert exact_sums(df.filter("g = 'z'"), [], "x").first()["sum"] is None


def test_every_sum_of_the_library_is_independent_of_partitions(spark):
    rng = random.Random(5)
    big = [rng.uniform(1, 9) * 1e16 for _ in range(60)]
    numbers = [x for b in big for x in (b, -b, 0.25)]
    rows = [(i, "a" if i % 2 else "b", "x" if i % 5 else "y", v) for i, v in enumerate(numbers)]
    seen = {}
    for partitions in (1, 3, 8):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "row_id long, g string, s string, v double").repartition(partitions)
        for how in ("sum", "average"):
            seen.setdefault(f"label {how}", set()).add(str(sorted(map(tuple, datasets.categorical(df, "g", "row_id", "v", how).points.collect()))))
            seen.setdefault(f"crosstab {how}", set()).add(str(sorted(map(tuple, datasets.crosstab(df, "g", "s", "row_id", "v", how).cells.collect()))))
            seen.setdefault(f"measure {how}", set()).add(str(sorted(map(tuple, answer({"t": df}, Measure(how, "v", groups=("g",)), "row_id").collect()))))
        seen.setdefault("cards", set()).add(str(sorted(map(tuple, report_cards(df, "g", "v", "s").cards.collect()))))
        for quartiles in (True, False):
            seen.setdefault("bundle", set()).add(str(sorted(tuple(r)[:4] for r in aggregate.numeric_bundle(df, ["g"], "v", quartiles).select("g", "n", "sum", "average").collect())))
    assert all(len(v) == 1 for v in seen.values()), seen
    assert "30" in str(seen["label sum"]) or math.fsum(numbers) == 15.0


def test_spread_from_one_pass_is_the_sample_deviation(spark):
    rng = random.Random(2)
    rows = [(i % 4, rng.uniform(1e6, 1e6 + 50) if i % 4 else rng.uniform(-1, 1) * 10.0 ** rng.randint(-3, 9)) for i in range(800)]
    df = spark.createDataFrame(rows, "g long, x double").repartition(5)
    got = {r["g"]: r["stdev"] for r in aggregate.numeric_bundle(df, ["g"], "x", quartiles=False).collect()}
    wanted = {r["g"]: r["s"] for r in df.groupBy("g").agg(F.round(F.stddev_samp("x"), 2).alias("s")).collect()}
    assert got == pytest.approx(wanted, abs=0.011)


def test_quantiles_of_a_heavy_tail_with_one_outlier(spark):
    """Nearly all of one group lies in a billionth of its span, and another group in a sliver of the first."""
    df = spark.range(40000).selectExpr(
        "CASE WHEN id % 4 = 0 THEN 'narrow' ELSE 'heavy' END AS g",
        "CASE WHEN id = 1 THEN 1e300 WHEN id % 4 = 0 THEN 1 + id * 1e-12 ELSE 1 / (1 + (id * 7919 % 40009)) END AS x",
    )
    probs = {"low": 0.01, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 0.999, "top": 1.0}
    got = {r["g"]: tuple(r)[1:] for r in exact_quantiles(df, ["g"], "x", probs).collect()}
    for group, values in df.toPandas().groupby("g")["x"]:
        assert got[group] == pytest.approx([values.quantile(p) for p in probs.values()], rel=1e-12)
