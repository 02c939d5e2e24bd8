"""Anti join, lookup, as-of, vocabulary checks, codes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import row_rank
from ..functions.text import fold_key, quoted, trimmed
from .cells import blank_of, cells, is_temporal, is_text, key_of, number_of, row_order, shared
from .quantiles import cut_points, with_cell


SPREAD = 1024


@dataclass(frozen=True)
class Matched:
    """All rows with what they gained, and the rows that found nothing."""

    rows: DataFrame
    unmatched: DataFrame


def _spread(df: DataFrame, absent: Column) -> Column:
    """0 for rows with a key; rows without one get one of many numbers that no other side has.

    As a second join key it keeps rows that cannot match from meeting in one task.
    """
    return F.when(absent, F.pmod(F.xxhash64(*[quoted(c) for c in df.columns]), F.lit(SPREAD)) + 1).otherwise(F.lit(0)).cast("long")


def anti_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of ``a`` whose key is not in ``b``; rows with a null key are left out."""
    known = b.select(key_of(b, key).alias("__k")).filter(F.col("__k").isNotNull()).distinct()
    rows = a.filter(quoted(key).isNotNull())
    return rows.join(known, key_of(rows, key) == F.col("__k"), "left_anti")


def lookup_join(a: DataFrame, b: DataFrame, key: str, bring: list[str], b_order) -> Matched:
    """Bring columns from the first row of ``b`` per key; a blank key finds nothing.

    ``b`` is cut to one row per key before the join, in every task first, so a
    repeated key in ``b`` cannot multiply rows.
    """
    first = Window.partitionBy("__k").orderBy(row_order(b_order))
    table = b.withColumn("__k", key_of(b, key)).filter(~blank_of(b, key))
    table = table.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").select(
        "__k", F.lit(True).alias("__hit"), *[quoted(c).alias(f"__b{i}") for i, c in enumerate(bring)]
    )
    kept = [c for c in a.columns if c not in bring]
    blank = blank_of(a, key)
    asked = a.withColumns({"__a": F.when(~blank, key_of(a, key)), "__spread": _spread(a, blank)})
    met = (F.col("__a") == F.col("__k")) & (F.col("__spread") == F.col("__none"))
    joined = asked.join(table.withColumn("__none", F.lit(0).cast("long")), met, "left")
    rows = joined.select(*[quoted(c) for c in kept], *[F.col(f"__b{i}").alias(c) for i, c in enumerate(bring)])
    return Matched(rows, joined.filter(F.col("__hit").isNull()).select(*[quoted(c) for c in a.columns]))


def _instant(df: DataFrame, column: str) -> Column:
    """A time as one number; what cannot be read comes before everything."""
    if is_temporal(df, column):
        at = F.unix_micros(quoted(column).cast("timestamp")).cast("double")
    elif is_text(df, column):
        at = row_rank(quoted(column))
    else:
        at = number_of(df, column)
    return F.coalesce(at, F.lit(float("-inf")))


def as_of_join(
    events: DataFrame, priors: DataFrame, key: str, time: str, bring: list[str], prior_order,
    prefix: str = "prior_", slice_width: float | None = None,
) -> Matched:
    """The latest prior at or before each event of the same key.

    Works on distinct (key, time) points: of several priors at one time only the
    last row counts, and events at one time share their answer.  Each key's
    points are cut into time slices that are searched on their own, and the last
    prior of every slice is carried to the slices after it, so a key with most
    of the rows spreads over its slices.  Slices hold about equally many points of
    all keys, so also a key whose rows lie close together is cut; ``slice_width``
    asks for equal spans of time instead.  Slices never change the result.
    """
    payload = F.struct(*[quoted(c).alias(f"b{i}") for i, c in enumerate(bring)])
    p = priors.filter(quoted(key).isNotNull()).select(
        key_of(priors, key).alias("__k"), _instant(priors, time).alias("__t"), payload.alias("__p"),
        row_order(prior_order).alias("__o"), F.lit(False).alias("__e"),
    )
    keyed = events.withColumn("__k", F.when(quoted(key).isNotNull(), key_of(events, key))).withColumn(
        "__t", _instant(events, time)
    )
    asked = keyed.filter(F.col("__k").isNotNull()).groupBy("__k", "__t").agg(F.lit(True).alias("__e"))
    latest = p.groupBy("__k", "__t").agg(F.max_by("__p", "__o").alias("__p"), F.bool_or("__e").alias("__e"))
    no_payload = F.lit(None).cast(latest.schema["__p"].dataType)
    points = latest.unionByName(asked.withColumn("__p", no_payload)).groupBy("__k", "__t").agg(
        F.max_by("__p", F.col("__p").isNotNull()).alias("__p"), F.bool_or("__e").alias("__e")
    )
    lowest = F.lit(-(2**62)).cast("long")
    points = shared(points, "__k", "__t", "__e")
    dated = F.when(F.col("__t") != float("-inf"), F.col("__t"))
    if slice_width is None:
        known = points.withColumn("__d", dated)
        cut = with_cell(known.withColumn("__cuts", cut_points(known, "__d")), "__d")
        points = cut.withColumn("__s", F.col("__cell")).drop("__cuts", "__cell", "__d")
    else:
        points = points.withColumn("__s", F.coalesce(F.floor(dated / F.lit(float(slice_width))), lowest))
    in_slice = Window.partitionBy("__k", "__s").orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    searched = points.withColumn("__here", F.last("__p", ignorenulls=True).over(in_slice)).filter("__e")
    slices = points.groupBy("__k", "__s").agg(
        F.max_by("__p", F.when(F.col("__p").isNotNull(), F.col("__t"))).alias("__last")
    )
    earlier = Window.partitionBy("__k").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("__k", "__s", F.last("__last", ignorenulls=True).over(earlier).alias("__carried"))
    answers = searched.join(carried, ["__k", "__s"]).select(
        "__k", "__t", F.coalesce("__here", "__carried").alias("__found")
    )
    keyed = keyed.withColumn("__spread", _spread(events, F.col("__k").isNull()))
    joined = keyed.join(answers.withColumn("__spread", F.lit(0).cast("long")), ["__k", "__t", "__spread"], "left")
    own = [quoted(c) for c in events.columns]
    rows = joined.select(*own, *[F.col("__found")[f"b{i}"].alias(prefix + c) for i, c in enumerate(bring)])
    return Matched(rows, joined.filter(F.col("__found").isNull()).select(*own))


def off_vocabulary(df: DataFrame, vocab: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Filled cells whose value is not a listed term of their column: ``column, value, n``.

    Cells are counted per value first, so the anti join sees distinct values.
    ``columns`` are those to check, by default every column of ``df``; a column
    without terms has no list to break.
    """
    values = cells(df, columns or df.columns).filter(F.col("value").isNotNull()).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )
    values = values.withColumn("__k", fold_key(F.col("value"))).filter("__k <> ''")
    terms = vocab.select(F.col("column"), fold_key(F.col("term")).alias("__k")).distinct()
    listed = values.join(terms.select("column").distinct(), "column", "left_semi")
    return listed.join(terms, ["column", "__k"], "left_anti").select("column", "value", "n")


def replace_by_codes(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Names in a column to their codes ``(name, code)``; unknown names stay."""
    table = codes.select(F.col("name").alias("__name"), F.col("code").alias("__code"))
    blank = blank_of(df, column)
    asked = df.withColumns({"__asked": F.when(~blank, trimmed(quoted(column))), "__spread": _spread(df, blank)})
    met = (F.col("__asked") == F.col("__name")) & (F.col("__spread") == F.col("__none"))
    joined = asked.join(table.withColumn("__none", F.lit(0).cast("long")), met, "left")
    return joined.select(*[
        F.coalesce(F.col("__code"), quoted(c).cast("string")).alias(c) if c == column else quoted(c)
        for c in df.columns
    ])
