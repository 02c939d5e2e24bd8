"""Counts, funnels, grouped statistics and descriptive tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import formats
from ..functions.numbers import round2, share
from ..functions.text import fold_key, is_blank, quoted
from ..functions.units import column_unit, duration_label
from .cells import blank_of, cells, is_numeric, is_text, join_on, key_of, number_of, row_order, shared, text_of
from .conditions import Condition, all_of, entity_flags, keep, keep_groups
from .quantiles import CELLS, counted_values, cut_points, quantiles_of
from .sums import exact_sums

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
STATISTICS = ("sum", "average", "median", "quartiles", "stdev", "min", "max", "range", "distinct")


# --- labels and counts ---------------------------------------------------------


def value_counts(df: DataFrame, column: str, order_by, by: list[str] = (), blanks: bool = False) -> DataFrame:
    """Non-blank values folded to one key: ``key, label, n, first``.

    The label is the spelling seen first.  Raw spellings are counted before the
    shuffle, so only one row per spelling and task moves, however common it is.
    ``blanks`` adds the count of blank cells under a null key.
    """
    filled = ~blank_of(df, column)
    raw = (df if blanks else df.filter(filled)).select(
        *[quoted(b) for b in by], F.when(filled, key_of(df, column)).alias("key"),
        F.when(filled, quoted(column)).alias("label"), row_order(order_by).alias("first"),
    )
    spelled = raw.groupBy(*by, "key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    if not is_text(df, column):
        return spelled
    return spelled.groupBy(*by, "key").agg(
        F.min_by("label", "first").alias("label"), F.sum("n").alias("n"), F.min("first").alias("first")
    ).select(*by, "key", "label", "n", "first")


def levels(df: DataFrame, column: str, order_by) -> DataFrame:
    """Distinct values in first-seen order."""
    return value_counts(df, column, order_by).orderBy("first").select("label", "n", "first")


def preview_count(df: DataFrame, groups) -> DataFrame:
    """How many rows the filter groups keep."""
    return keep_groups(df, groups).agg(F.count(F.lit(1)).alias("rows"))


def preview_tally(df: DataFrame, groups, columns: list[str], order_by) -> DataFrame:
    """Rows per combination of one or two columns, label joined by `` / ``."""
    rows = keep_groups(df, groups)
    for c in columns:
        rows = rows.filter(~blank_of(rows, c))
    keys = [key_of(rows, c).alias(f"__k{i}") for i, c in enumerate(columns)]
    label = F.concat_ws(" / ", *[text_of(rows, c) for c in columns]).alias("label")
    spelled = rows.select(*keys, label, row_order(order_by).alias("first")).groupBy(
        *[f"__k{i}" for i in range(len(columns))], "label"
    ).agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first"))
    return spelled.groupBy(*[f"__k{i}" for i in range(len(columns))]).agg(
        F.min_by("label", "first").alias("label"), F.sum("n").alias("n"), F.min("first").alias("first")
    ).orderBy(F.desc("n"), "first").select("label", "n")


# --- funnels --------------------------------------------------------------------


def _stage_rows(totals: DataFrame, phrases: list[str]) -> DataFrame:
    """One row of totals to one row per stage."""
    stages = F.array(*[
        F.struct(
            F.lit(i).alias("stage"), F.lit(phrase).alias("checked"),
            F.col(f"alive_{i}").alias("matched"), F.col(f"alive_{i - 1}").alias("out_of"),
            share(F.col(f"alive_{i}"), F.col(f"alive_{i - 1}")).alias("share_pct"),
            F.col(f"unreadable_{i}").alias("unreadable"), F.col(f"blank_{i}").alias("blank_cells"),
        )
        for i, phrase in enumerate(phrases, start=1)
    ])
    return totals.select(F.inline(stages))


def funnel(df: DataFrame, stages: list[Condition]) -> DataFrame:
    """Nested counts, each stage out of the one before, in one pass (A1)."""
    totals = [F.count(F.lit(1)).alias("alive_0")]
    for i, stage in enumerate(stages, start=1):
        entering = all_of(df, stages[: i - 1])
        totals += [
            F.count_if(entering & stage.test(df)).alias(f"alive_{i}"),
            F.count_if(entering & stage.unreadable(df)).alias(f"unreadable_{i}"),
            F.count_if(entering & stage.blank_cell(df)).alias(f"blank_{i}"),
        ]
    return _stage_rows(df.agg(*totals), [s.phrase for s in stages])


def entity_funnel(df: DataFrame, entity: str, stages: list[Condition]) -> DataFrame:
    """The same funnel over entities; rows without an entity are left out (A2)."""
    flags = entity_flags(df, entity, stages)
    totals, alive = [F.count(F.lit(1)).alias("alive_0")], F.lit(True)
    for i in range(1, len(stages) + 1):
        entering, alive = alive, alive & F.col(f"pass_{i - 1}")
        totals += [
            F.count_if(alive).alias(f"alive_{i}"),
            F.coalesce(F.sum(F.when(entering, F.col(f"unreadable_{i - 1}"))), F.lit(0)).alias(f"unreadable_{i}"),
            F.lit(0).cast("long").alias(f"blank_{i}"),
        ]
    return _stage_rows(flags.agg(*totals), [s.phrase for s in stages])


def last_stage_text(stages: DataFrame) -> DataFrame:
    """The last stage as ``n (p%)`` with its denominator."""
    last = stages.orderBy(F.desc("stage")).limit(1)
    return last.select(
        formats.n_percent(F.col("matched"), F.col("out_of")).alias("n_percent"), "out_of", "blank_cells"
    )


def group_share(df: DataFrame, column: str, order_by, conditions: list[Condition] = ()) -> DataFrame:
    """Count and share per value; the share is of all filtered rows (A3)."""
    rows = keep(df, list(conditions))
    counts = shared(value_counts(rows, column, order_by, blanks=True))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    percent = F.when(F.col("key").isNotNull(), share(F.col("n"), total))
    return counts.withColumn("share_pct", percent).filter("share_pct IS NOT NULL").select("label", "n", "share_pct", "first")


# --- statistics -----------------------------------------------------------------


def _bundle(sums: DataFrame, by: list[str]) -> DataFrame:
    """The statistics that follow from counts, sums, extremes and the variance ``__v``."""
    n = F.col("n")
    return sums.select(
        *by, "rows", "n", (F.col("rows") - n).alias("skipped"), "sum", round2(F.col("sum") / F.when(n > 0, n)).alias("average"),
        round2(F.when(n >= 2, F.sqrt("__v"))).alias("stdev"), "min", "max", round2(F.col("max") - F.col("min")).alias("range"),
    )


def numeric_bundle(df: DataFrame, by: list[str], value: str, quartiles: bool = True) -> DataFrame:
    """Every statistic of the readable numbers in ``value`` per ``by``.

    ``value`` is already numeric.  No readable number gives nulls, never 0.  With
    quartiles all statistics come from one count of the distinct values.
    """
    x, times = F.col(value), F.col("__c")
    if not quartiles:
        # A bin's spread and the distance of its mean from the group's give the group's spread.
        within = F.struct(F.col("n").alias("n"), F.col("mean").alias("mean"), F.col("spread").alias("spread"))
        sums = exact_sums(
            df, by, value, partial={
                "rows": F.count(F.lit(1)), "n": F.count(x), "min": F.min(x), "max": F.max(x), "mean": F.avg(x), "spread": F.var_pop(x),
            }, final={
                "rows": F.sum("rows"), "n": F.sum("n"), "min": F.min("min"), "max": F.max("max"),
                "__bins": F.collect_list(F.when(F.col("n") > 0, within)),
            },
        )
        mean = F.col("sum") / F.col("n")
        apart = F.aggregate(
            F.sort_array("__bins"), F.lit(0.0), lambda acc, b: acc + b["n"] * (b["spread"] + (b["mean"] - mean) * (b["mean"] - mean))
        )
        return _bundle(sums.withColumn("__v", apart / (F.col("n") - 1)), by)
    counted = counted_values(df, by, value)
    cuts = cut_points(counted, value)
    # Deviations are taken from a middle value of all rows, which keeps their squares small.
    apart = x - F.coalesce(F.get(cuts, F.lit(CELLS // 2 - 1)), F.lit(0.0))
    sums = exact_sums(
        counted, by, value, times="__c", partial={
            "rows": F.sum(times), "n": F.coalesce(F.sum(F.when(x.isNotNull(), times)), F.lit(0)), "min": F.min(x), "max": F.max(x),
            "__s": F.sum(apart * times), "__q": F.sum(apart * apart * times),
        }, final={
            "rows": F.sum("rows"), "n": F.sum("n"), "min": F.min("min"), "max": F.max("max"), "__s": F.sum("__s"), "__q": F.sum("__q"),
        },
    )
    variance = (F.col("__q") - F.col("__s") * F.col("__s") / F.col("n")) / (F.col("n") - 1)
    bundle = _bundle(sums.withColumn("__v", F.greatest(variance, F.lit(0.0))), by)
    exact = quantiles_of(counted, cuts, by, value, QUARTILES)
    if by:
        exact = join_on(bundle, exact, by, "left")
    else:
        found = exact.agg(F.struct(*[F.max(q).alias(q) for q in QUARTILES])).scalar()
        exact = bundle.withColumn("__q", found).select("*", "__q.*").drop("__q")
    return exact.withColumn("iqr", round2(F.col("q3") - F.col("q1"))).withColumns(
        {q: round2(F.col(q)) for q in QUARTILES}
    )


def distinct_count(df: DataFrame, column: str, by: list[str] = (), approximate: bool = False) -> DataFrame:
    """Distinct folded values; blanks are no value, markers are one (A10)."""
    key = F.when(~blank_of(df, column), key_of(df, column))
    count = F.approx_count_distinct(key) if approximate else F.count_distinct(key)
    return df.groupBy(*by).agg(count.alias("distinct"))


def summarise(df: DataFrame, value: str, statistics: list[str], group: str | None = None, order_by=None) -> DataFrame:
    """Chosen statistics of one column, overall or per group.

    Statistics that need no ranking never pay for the quantile pass.
    """
    unknown = set(statistics) - set(STATISTICS)
    if unknown:
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    by = ["key"] if group else []
    rows = df.filter(~blank_of(df, group)) if group else df
    keyed = rows.select(
        *([key_of(df, group).alias("key")] if group else []),
        number_of(df, value).alias("__x"), quoted(value).alias("__raw"),
    )
    wants_quartiles = bool({"median", "quartiles"} & set(statistics))
    out = numeric_bundle(keyed, by, "__x", wants_quartiles)
    columns = ["rows", "n", "skipped"]
    for s in statistics:
        columns += ["q1", "median", "q3", "iqr"] if s == "quartiles" else [s]
    if "distinct" in statistics:
        d = distinct_count(keyed, "__raw", by)
        out = join_on(out, d, by) if group else out.withColumn("distinct", d.scalar())
    columns = list(dict.fromkeys(columns))
    if not group:
        return out.select(*columns)
    labels = value_counts(df, group, order_by).select("key", "label", "first")
    return labels.join(out, "key").select("label", *columns, "first")


def describe(df: DataFrame, value: str, group: str | None = None, order_by=None) -> DataFrame:
    """n, missing, mean (SD), median (IQR) and the range, as a report states them."""
    stats = summarise(df, value, ["average", "stdev", "quartiles", "min", "max"], group, order_by)
    low, high = formats.plain_number(F.col("min")), duration_label(F.col("max"), value)
    return stats.select(
        *(["label"] if group else []), "n", F.col("skipped").alias("missing"),
        formats.mean_sd(F.col("average"), F.col("stdev")).alias("mean_sd"),
        formats.median_iqr(F.col("median"), F.col("q1"), F.col("q3")).alias("median_iqr"),
        F.when(F.col("n") == 0, F.lit("no readable numbers")).otherwise(F.concat(low, F.lit("–"), high)).alias("min_max"),
    )


def table1(df: DataFrame, columns: list[str], order_by, numeric: list[str] | None = None) -> DataFrame:
    """Many columns in one descriptive table.

    ``numeric`` names the text columns to read as numbers; typed numbers always
    are.  All categorical columns share one pass over the rows and all numeric
    columns another.  Levels come by count, then by first sight.
    """
    numbers = [c for c in columns if is_numeric(df, c) or c in (numeric or [])]
    categories = [c for c in columns if c not in numbers]
    place = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    parts = []
    if categories:
        spelled = cells(df, categories, first=row_order(order_by)).withColumn(
            "key", F.when(~is_blank(F.col("value")), fold_key(F.col("value")))
        ).groupBy("column", "key", F.when(F.col("key").isNotNull(), F.col("value")).alias("value")).agg(
            F.count(F.lit(1)).alias("n"), F.min("first").alias("first")
        )
        level = spelled.groupBy("column", "key").agg(
            F.min_by("value", "first").alias("label"), F.sum("n").alias("n"), F.min("first").alias("first")
        )
        totals = level.groupBy("column").agg(
            F.coalesce(F.sum(F.when(F.col("key").isNull(), F.col("n"))), F.lit(0)).alias("missing"),
            F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.col("n"))), F.lit(0)).alias("denominator"),
        )
        heads = totals.select(
            "column", F.concat("column", F.lit(" — n (%)")).alias("characteristic"), F.lit("").alias("summary"),
            F.col("missing"), F.lit(None).cast("long").alias("n"),
        )
        rows = level.filter(F.col("key").isNotNull()).join(F.broadcast(totals), "column").select(
            "column", F.concat(F.lit("  "), "label").alias("characteristic"),
            formats.n_percent(F.col("n"), F.col("denominator")).alias("summary"),
            F.lit(None).cast("long").alias("missing"), "n", "first",
        )
        parts += [heads, rows]
    if numbers:
        entries = F.array(*[
            F.struct(F.lit(c).alias("column"), number_of(df, c).alias("__x")) for c in numbers
        ])
        stats = numeric_bundle(df.select(F.inline(entries)), ["column"], "__x")
        unit = F.create_map(*[F.lit(x) for c in numbers for x in (c, column_unit(c) or "")])
        text = formats.numeric_summary(
            F.col("median"), F.col("q1"), F.col("q3"), F.col("average"), F.col("stdev"),
            F.element_at(unit, F.col("column")),
        )
        parts.append(stats.select(
            "column", F.col("column").alias("characteristic"), text.alias("summary"),
            F.col("skipped").alias("missing"), F.lit(None).cast("long").alias("n"),
        ))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    order = ["position", F.desc_nulls_first("n"), *(["first"] if categories else [])]
    return out.withColumn("position", F.element_at(place, F.col("column"))).orderBy(*order).select("position", "characteristic", "summary", "missing")


# --- pooled frequencies -------------------------------------------------------------


def _place(df: DataFrame, order_by, width: int) -> Column:
    """Row, then column: one number where the row order is one whole number."""
    single = order_by if isinstance(order_by, str) else order_by[0] if len(order_by) == 1 else None
    if single and isinstance(df.schema[single].dataType, (T.IntegerType, T.LongType, T.DecimalType)):
        return F.col("row").cast("decimal(38,0)") * width + F.col("at")
    return F.struct("row", "at")


def pooled_counts(
    df: DataFrame, columns: list[str], order_by, policy: str = "occurrence", entity: str | None = None
) -> DataFrame:
    """Frequencies of one value over several columns.

    ``occurrence`` counts every filled cell, ``row`` counts a value once per row,
    ``entity`` once per entity; rows without an entity count each on its own.
    Repeats inside a row are dropped before anything is shuffled.
    """
    who = []
    if policy == "entity":
        blank = blank_of(df, entity)
        who = [
            F.when(~blank, key_of(df, entity)).alias("entity"),
            F.when(blank, row_order(order_by)).alias("alone"),
        ]
    keyed = df.select(
        *who, row_order(order_by).alias("row"),
        *[F.when(~blank_of(df, c), key_of(df, c)).alias(f"k{i}") for i, c in enumerate(columns)],
        *[text_of(df, c).alias(f"l{i}") for i, c in enumerate(columns)],
    )

    def counts(i: int) -> Column:
        """Filled, and under a per-row policy not said by an earlier column."""
        earlier = [] if policy == "occurrence" else [F.col(f"k{j}").eqNullSafe(F.col(f"k{i}")) for j in range(i)]
        return reduce(and_, [~e for e in earlier], F.col(f"k{i}").isNotNull())

    said = F.array(*[
        F.struct(F.when(counts(i), F.col(f"k{i}")).alias("key"), F.col(f"l{i}").alias("label"), F.lit(i).alias("at"))
        for i in range(len(columns))
    ])
    names = [c for c in ("entity", "alone") if policy == "entity"]
    mentions = keyed.select(*names, "row", F.inline(said)).filter("key IS NOT NULL").select(
        *names, "key", "label", _place(df, order_by, len(columns)).alias("first")
    )
    labels = mentions.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("first")).groupBy(
        "key"
    ).agg(F.min_by("label", "first").alias("label"), F.sum("n").alias("n"), F.min("first").alias("first"))
    if policy != "entity":
        return labels
    once = mentions.select("entity", "alone", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return labels.drop("n").join(once, "key").select("key", "label", "n", "first")


def pooled_totals(df: DataFrame, columns: list[str], entity: str | None = None) -> DataFrame:
    """Rows, blank cells and rows without an entity behind a pooled ranking."""
    blanks = sum([F.count_if(blank_of(df, c)) for c in columns], F.lit(0))
    no_entity = F.count_if(blank_of(df, entity)) if entity else F.lit(0).cast("long")
    return df.agg(F.count(F.lit(1)).alias("rows"), blanks.alias("blank_cells"), no_entity.alias("no_entity"))
