"""One card per person and group, compared with the others of the group.

Takes only the coded table; a report cannot hold a name it never saw.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted
from ..operators.cells import blank_of, number_of, text_of
from ..operators.sums import exact_sums

SMALL_CELL = 2


@dataclass(frozen=True)
class ReportCards:
    """``cards`` has one row per person and group; ``peers`` is what each is compared to.

    The two are joined only for the people asked for (``bars``), so no table
    ever holds every pair of a group.
    """

    cards: DataFrame
    peers: DataFrame
    warnings: DataFrame


def person_totals(df: DataFrame, person: str, value: str | None = None, group: str | None = None) -> DataFrame:
    """Sum or row count per person and group."""
    rows = df.filter(~blank_of(df, person))
    where = F.coalesce(text_of(rows, group), F.lit("(no group)")) if group else F.lit("(all)")
    if value is None:
        return rows.groupBy(text_of(rows, person).alias("person"), where.alias("group")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    numbers = rows.select(text_of(rows, person).alias("person"), where.alias("group"), number_of(rows, value).alias("__x"))
    return exact_sums(numbers, ["person", "group"], "__x", "value").fillna(0.0, ["value"])


def report_cards(df: DataFrame, person: str, value: str | None = None, group: str | None = None) -> ReportCards:
    """Cards, peers and a warning per group of one or two people."""
    totals = person_totals(df, person, value, group)
    groups = exact_sums(
        totals, ["group"], "value", "__sum", partial={"group_size": F.count(F.lit(1)), "group_max": F.max("value")},
        final={"group_size": F.sum("group_size"), "group_max": F.max("group_max")},
    )
    groups = groups.select("group", "group_size", "group_max", (F.col("__sum") / F.col("group_size")).alias("group_mean"))
    cards = totals.join(groups, "group").select(
        "person", "group", "value", "group_size", "group_max", "group_mean",
        (F.col("group_size") <= SMALL_CELL).alias("small_cell"),
    )
    small = groups.filter(F.col("group_size") <= SMALL_CELL).select("group", F.col("group_size").alias("people"))
    return ReportCards(cards, totals, small)


def bars(cards: ReportCards, people: list[str]) -> DataFrame:
    """The peer bars of the named people, largest first, the person's own marked."""
    subjects = cards.cards.filter(F.col("person").isin(*people)).select(F.col("person").alias("subject"), "group")
    return subjects.join(cards.peers, "group").select(
        "subject", "group", F.col("person").alias("label"), "value",
        (F.col("person") == F.col("subject")).alias("is_subject"),
    ).orderBy("subject", "group", F.desc("value"), "label")
