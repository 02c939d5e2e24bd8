"""Exact quantiles that hold up when one group has most of the rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cells import join_on, shared

CELLS = 1024
STEPS = [CELLS >> i for i in range(1, CELLS.bit_length())]


def counted_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Every distinct value per ``by`` with its number of rows ``__c``: the one shuffle over the rows.

    Null is a value of its own here, so that one count serves every statistic.
    """
    return shared(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("__c")))


def cut_points(counted: DataFrame, value: str) -> Column:
    """Values that cut the counted values into cells of nearly equal size, as one scalar array."""
    # One literal array; as many single literals would cost more to plan than the query to run.
    cuts = F.percentile_approx(value, F.lit(np.arange(1, CELLS) / CELLS), 10 * CELLS)
    return counted.agg(cuts.alias("cuts")).select("cuts").scalar()


def exact_quantiles(df: DataFrame, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Linear-interpolation quantiles (type 7) of ``value`` per ``by``, one column per prob."""
    counted = counted_values(df, by, value)
    return quantiles_of(counted, cut_points(counted, value), by, value, probs)


def quantiles_of(counted: DataFrame, cuts: Column, by: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """The quantiles of counted values; a group without a value has no row.

    The counted values are cut into ``CELLS`` cells by a sketch over all groups, so a
    (group, cell) pair holds at most that share of all counted values, however the
    values are spread and however large its group is.  Cell totals tell exactly which
    cells hold the wanted ranks, and only those are sorted.  The cuts balance the
    work; they cannot change a result.
    """
    counted = counted.withColumn("__c", F.when(F.col(value).isNotNull(), F.col("__c")).otherwise(F.lit(0)))
    counted = with_cell(counted.withColumn("__cuts", cuts), value).drop("__cuts")
    cells = counted.groupBy(*by, "__cell").agg(F.sum("__c").alias("__in"))
    targets = _holding(cells.withColumn("__n", F.sum("__in").over(Window.partitionBy(*by))), by, probs)
    in_cell = Window.partitionBy(*by, "__cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    placed = join_on(counted, targets, [*by, "__cell"]).select(
        *by, value, "__n", (F.col("__below") + F.sum("__c").over(in_cell)).alias("__end"), "__c",
    )
    ranks = {name: _ranks(F.col("__n"), p) for name, p in probs.items()}
    at = lambda r: F.max(F.when((r >= F.col("__end") - F.col("__c")) & (r < F.col("__end")), F.col(value)))
    picked = placed.groupBy(*by, "__n").agg(*[
        agg.alias(f"__{name}_{side}")
        for name, (low, high, _) in ranks.items()
        for side, agg in (("lo", at(low)), ("hi", at(high)))
    ])
    return picked.select(*by, *[
        (F.col(f"__{name}_lo") + ranks[name][2] * (F.col(f"__{name}_hi") - F.col(f"__{name}_lo"))).alias(name)
        for name in probs
    ])


def _holding(cells: DataFrame, by: list[str], probs: dict[str, float]) -> DataFrame:
    """The cells that hold a wanted rank, with the rows of their group ``__n`` and of its earlier cells ``__below``."""
    up_to = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, 0)
    below = F.sum("__in").over(up_to) - F.col("__in")
    wanted = reduce(or_, [
        (r >= F.col("__below")) & (r < F.col("__below") + F.col("__in"))
        for p in probs.values() for r in _ranks(F.col("__n"), p)[:2]
    ])
    return cells.withColumn("__below", below).filter(wanted).select(*by, "__cell", "__n", "__below")


def with_cell(df: DataFrame, value: str) -> DataFrame:
    """Add how many cut points lie below ``value``, by halving the sorted cuts.

    One projection per step, so each step reads the one before and the whole
    search stays in generated code.  The result is never null, so a join on it
    puts no extra filter below the counting.
    """
    df = df.withColumn("__cell", F.lit(0))
    for step in STEPS:
        cut = F.get(F.col("__cuts"), F.col("__cell") + (step - 1))
        up = F.when(cut < F.col(value), F.lit(step)).otherwise(F.lit(0))
        df = df.withColumn("__cell", F.col("__cell") + up)
    return df


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """The zero-based ranks on both sides of quantile ``p``, and the step between."""
    at = (n - 1) * F.lit(p)
    return F.floor(at), F.ceil(at), at - F.floor(at)
