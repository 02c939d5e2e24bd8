"""Shards that all hold the same mixture of sources, by proportional interleaving.

Rows are shuffled by a seeded digest inside their source and ranked there.  The
fractional rank ``(2 rank + 1) / (2 n)`` spreads every source evenly over (0, 1);
sorting all rows by it interleaves the sources in proportion, and equal cuts of that
order are the shards.  Everything is DataFrame functions.

No window or task holds a source: ranks come from a range sort over (source, digest),
so a source with a third of all rows covers many partitions, and each partition's
first place is shifted by the rows of its source in the partitions before.  Only the
named columns travel, never the text.

Defined cases: a null source is a source of its own; null and repeated keys are
ordinary rows (ties are ordered by the other columns, rows equal in all of them are
interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, placed, stored


def interleave(rows: DataFrame, key: str, source: str, shards: int, seed: str = "0") -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... in its shard).

    Shard sizes differ by at most one row, and so do a source's shares, up to the
    rounding of its own size.  ``rows`` should hold only what the result needs.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))
    names = [c for c in rows.columns]
    fixed = stored(rows.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), group.alias("__group"), digest.alias("__digest")
    ))
    total = fixed.count()
    ranked = placed(fixed, [F.col("__group"), F.col("__digest"), F.col("__row")])
    parts = ranked.groupBy("__group", "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__pos").alias("__first"))
    of_group = Window.partitionBy("__group")
    before = of_group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "__group", "__part",
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__n").over(of_group).alias("__size"),
    )
    rank = F.col("__pos") + F.col("__shift")
    spread = ranked.join(parts, ["__group", "__part"]).select(
        "__row", "__group", "__digest",
        ((rank * 2 + 1).cast("double") / (F.col("__size") * 2).cast("double")).alias("__fraction"),
    )
    order = [F.col("__fraction"), F.md5(F.concat_ws(":", F.lit(seed), F.col("__group"))), F.col("__digest"), F.col("__row")]
    place = numbered(spread, order, "__place")
    shard = F.expr(f"__place * {shards} div {max(total, 1)}")
    first = F.expr(f"(({shards} - 1) + __shard * {total}) div {shards}")
    return place.withColumn("__shard", shard).select(
        *[F.col("__row").getField(c).alias(c) for c in names],
        F.col("__shard").cast("int").alias("shard"), (F.col("__place") - first).cast("long").alias("slot"),
    )
