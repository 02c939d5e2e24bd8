"""Which rows survive: duplicates, copies with an id, one row per entity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import row_rank
from ..functions.text import entity_key, quoted
from .cells import blank_of, is_numeric, is_temporal, is_text, row_order


# A group is ranked in so many parts before the first rows of the parts are.
PARTS = 64


@dataclass(frozen=True)
class Split:
    """Rows a step kept and rows it removed; removed rows stay inspectable.

    ``marked`` is the input with ``__kept``: both kinds of rows from one reading.
    """

    kept: DataFrame
    marked: DataFrame

    @property
    def removed(self) -> DataFrame:
        return self.marked.filter(~F.col("__kept")).drop("__kept")


def _order_names(order_by) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def content_digest(columns: list[str]) -> list[Column]:
    """128 bits of a row's content; nulls, which a hash passes over, are part of it."""
    cells = [quoted(c) for c in columns]
    nulls = F.concat(F.lit(""), *[F.when(c.isNull(), "1").otherwise("0") for c in cells])
    return [F.xxhash64(nulls, *cells), F.xxhash64(F.lit("second"), nulls, *cells)]


def mark_first(df: DataFrame, keys: list[Column], best: list[Column], among: Column, columns: list[str]) -> DataFrame:
    """``df`` with ``__kept``: false for rows ``among`` that are not the first of their ``keys`` by ``best``.

    Groups are ranked in ``PARTS`` parts, then the first rows of the parts among each
    other, so a group of any size is shared out.  Rows outside ``among`` are keys of their own.
    Rows equal in all ``columns`` are interchangeable; one of them is the first.
    """
    own = F.xxhash64(F.spark_partition_id(), *[quoted(c) for c in columns])
    names = [f"__k{i}" for i in range(len(keys))]
    keyed = df.select(
        "*", F.coalesce(among, F.lit(False)).alias("__among"), *[F.when(among, k).alias(n) for n, k in zip(names, keys)],
        F.when(among, F.pmod(own, F.lit(PARTS))).otherwise(own).alias("__part"),
        *[c.alias(f"__o{i}") for i, (c, _) in enumerate(best)],
    )
    order = [way(F.col(f"__o{i}")) for i, (_, way) in enumerate(best)]
    part = Window.partitionBy(*names, "__among", "__part").orderBy(*order)
    ranked = keyed.withColumn("__later", F.row_number().over(part) > 1)
    # Rows that are not first in their part are spread, the others meet.
    apart = F.when(F.col("__later") | ~F.col("__among"), own)
    group = Window.partitionBy(*names, "__among", apart).orderBy(*order)
    first = F.row_number().over(group) == 1
    return ranked.withColumn("__kept", ~F.col("__among") | (~F.col("__later") & first)).select(*df.columns, "__kept")


def _first_copies(df: DataFrame, order_by) -> DataFrame:
    """One row per distinct content, the earliest.

    The content is the grouping key itself, so copies collapse inside each task
    before the shuffle and no window sorts them.
    """
    names = _order_names(order_by)
    content = [c for c in df.columns if c not in names]
    groups = df.groupBy(*[quoted(c) for c in content]).agg(F.min(row_order(order_by)).alias("__first"))
    first = [F.col("__first").alias(names[0])] if len(names) == 1 else [
        F.col("__first")[n].alias(n) for n in names
    ]
    restored = groups.select(*[quoted(c) for c in content], *first)
    return restored.select(*[quoted(c) for c in df.columns])


def mark_copies(df: DataFrame, order_by, columns: list[str], among: Column) -> DataFrame:
    """``__kept`` for the first of every set of copies ``among`` the rows, compared in ``columns`` but their order."""
    names = _order_names(order_by)
    digest = content_digest([c for c in columns if c not in names])
    return mark_first(df, digest, [(row_order(order_by), Column.asc)], among, columns)


def dedupe_rows(df: DataFrame, order_by) -> Split:
    """Keep the first of every set of exact copies."""
    return Split(_first_copies(df, order_by), mark_copies(df, order_by, df.columns, F.lit(True)))


def dedupe_encounters(df: DataFrame, id_column: str, order_by) -> Split:
    """Remove exact copies only where the id is filled."""
    blank = blank_of(df, id_column)
    kept = _first_copies(df.filter(~blank), order_by).unionByName(df.filter(blank))
    return Split(kept, mark_copies(df, order_by, df.columns, ~blank))


def keep_one(df: DataFrame, entity: str, policy: str, order_by) -> Split:
    """One row per entity by ``first::date``, ``last::date``, ``complete``, ``firstrow``, ``lastrow``.

    Rows without an entity are all kept and never ranked.  A row without a readable
    date loses to any with one; ties go to the earliest row, and where the row order
    repeats, to the least content digest, so every evaluation picks the same row.
    The ``row_number() = 1`` filter lets Spark drop all but one row per entity in
    every task before the shuffle.
    """
    blank = blank_of(df, entity)
    best = _best(df, policy, order_by, df.columns)
    window = Window.partitionBy(entity_of(df, entity)).orderBy(*[way(c) for c, way in best])
    ranked = df.filter(~blank).withColumn("__rn", F.row_number().over(window)).filter("__rn = 1").drop("__rn")
    return Split(ranked.unionByName(df.filter(blank)), mark_survivors(df, entity, policy, order_by, df.columns, F.lit(True)))


def entity_of(df: DataFrame, entity: str) -> Column:
    return entity_key(quoted(entity)) if is_text(df, entity) else quoted(entity)


def mark_survivors(df: DataFrame, entity: str, policy: str, order_by, columns: list[str], among: Column) -> DataFrame:
    """``__kept`` for the row of each entity that the policy chooses ``among`` the rows."""
    best = _best(df, policy, order_by, columns)
    return mark_first(df, [entity_of(df, entity)], best, among & ~blank_of(df, entity), columns)


def _best(df: DataFrame, policy: str, order_by, columns: list[str]) -> list[tuple[Column, Callable[[Column], Column]]]:
    """What a policy ranks rows by, and which way."""
    mode, _, date_column = policy.partition("::")
    settled = (F.xxhash64(*[quoted(c) for c in columns]), Column.asc)
    place = row_order(order_by)
    if mode in ("first", "last"):
        way = Column.asc_nulls_last if mode == "first" else Column.desc_nulls_last
        return [(_moment(df, date_column), way), (place, Column.asc), settled]
    if mode == "complete":
        names = _order_names(order_by)
        filled = sum([(~blank_of(df, c)).cast("int") for c in columns if c not in names], F.lit(0))
        return [(filled, Column.desc), (place, Column.asc), settled]
    if mode in ("firstrow", "lastrow"):
        return [(place, Column.asc if mode == "firstrow" else Column.desc), settled]
    raise ValueError(f"unknown policy {policy!r}")


def _moment(df: DataFrame, column: str):
    if is_text(df, column):
        return row_rank(quoted(column))
    if is_numeric(df, column) or is_temporal(df, column):
        return quoted(column)
    raise ValueError(f"{column!r} holds neither dates nor numbers")
