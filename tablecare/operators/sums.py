"""Sums of doubles that are the same bits in any order of the rows.

A double is a whole number of quanta; numbers of ``WIDTH`` neighbouring exponents share a
quantum and form a bin.  Per group and bin the whole numbers are added in three limbs of
21 bits, so the sums are exact for up to 2^42 rows of one group, combine in every task
and do not depend on partitions.  A group has a few bins; those are added, largest first,
with the rounding errors carried along (the order is fixed by the bins), so large numbers
that cancel leave the small ones.  Digits below 2^-997 are dropped.

A group with an infinity or a NaN has the sum that these give; a group without numbers
has a null sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted

WIDTH = 8
DIGITS = 53
LEAST_BIN = -118
LIMB = 21


def _quantum(bin_: Column) -> Column:
    return F.pow(F.lit(2.0), bin_ * WIDTH - DIGITS)


def _limbs(x: Column, bin_: Column) -> list[Column]:
    """The number of quanta in ``x``, cut into limbs; the last one has the sign."""
    whole = (x / _quantum(bin_)).cast("bigint")
    low = F.lit((1 << LIMB) - 1).cast("bigint")
    return [whole.bitwiseAND(low), F.shiftright(whole, LIMB).bitwiseAND(low), F.shiftright(whole, 2 * LIMB)]


def _terms(part: Column) -> Column:
    """The doubles a bin adds: each limb as its nearest double and what that leaves."""
    out = []
    for i in (2, 1, 0):
        limb, scale = part[f"l{i}"], F.pow(F.lit(2.0), part["bin"] * WIDTH - DIGITS + LIMB * i)
        near = limb.cast("double")
        out += [near * scale, (limb - near.cast("bigint")).cast("double") * scale]
    return F.array(*out)


def _added(acc: Column, y: Column) -> Column:
    """Running sum and the errors of its roundings."""
    total = acc["sum"] + y
    part = total - acc["sum"]
    return F.struct(total.alias("sum"), (acc["error"] + ((acc["sum"] - (total - part)) + (y - part))).alias("error"))


def total_of(parts: Column) -> Column:
    """The sum of a group's bins."""
    terms = F.flatten(F.transform(F.sort_array(parts, False), _terms))
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("error"))
    return F.aggregate(terms, start, _added, lambda acc: acc["sum"] + acc["error"])


def with_bin(df: DataFrame, value: str) -> DataFrame:
    """Add ``__bin``, the bin of the double in ``value``; null for nothing, zero, NaN and infinities."""
    x = F.col(value).cast("double")
    some = F.greatest(F.floor(F.log2(F.abs(x)) / WIDTH).cast("int"), F.lit(LEAST_BIN))
    return df.withColumn("__bin", F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")) & (x != 0), some))


def bin_sums(value: str, times: str | None = None) -> list[Column]:
    """The aggregates of one bin: its limbs, how many numbers there are, and the sum of those that are not finite."""
    x = F.col(value).cast("double")
    weight = F.lit(1).cast("bigint") if times is None else F.col(times)
    odd = F.sum(F.when(F.isnan(x) | (F.abs(x) == float("inf")), x))
    return [
        *[F.sum(limb * weight).alias(f"__l{i}") for i, limb in enumerate(_limbs(x, F.col("__bin")))], F.count(x).alias("__some"), odd.alias("__odd"),
    ]


def merged_sums() -> list[Column]:
    """The aggregates that make the parts of a coarser key's bin from those of finer keys."""
    return [F.sum(c).alias(c) for c in ("__l0", "__l1", "__l2", "__some", "__odd")]


def add_up(parts: DataFrame, by: list[str], name: str, **final: Column) -> DataFrame:
    """One row per ``by`` with the sum of its bins, of which ``parts`` has one row each, and other aggregates."""
    bins = F.struct(F.col("__bin").alias("bin"), *[F.col(f"__l{i}").alias(f"l{i}") for i in range(3)])
    whole = parts.groupBy(*[quoted(b) for b in by]).agg(
        F.collect_list(F.when(F.col("__bin").isNotNull(), bins)).alias("__parts"), F.sum("__some").alias("__some"), F.sum("__odd").alias("__odd"),
        *[c.alias(n) for n, c in final.items()],
    )
    total = F.when(F.col("__some") > 0, F.coalesce("__odd", total_of(F.col("__parts"))))
    return whole.withColumn(name, total).drop("__parts", "__some", "__odd")


def exact_sums(
    df: DataFrame, by: list[str], value: str, name: str = "sum", times: str | None = None,
    partial: dict[str, Column] | None = None, final: dict[str, Column] | None = None,
) -> DataFrame:
    """Per ``by`` the sum of ``value`` (times the counts in ``times``), and other aggregates of the same pass.

    ``partial`` are aggregates per group and bin, ``final`` those of them per group.
    """
    parts = with_bin(df, value).groupBy(*[quoted(b) for b in by], "__bin").agg(
        *bin_sums(value, times), *[c.alias(n) for n, c in (partial or {}).items()]
    )
    return add_up(parts, by, name, **(final or {}))
