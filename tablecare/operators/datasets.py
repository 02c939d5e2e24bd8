"""Chart datasets as tidy tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import looks_like_time, period_label, period_label_typed, time_order
from ..functions.formats import plain_number
from ..functions.numbers import half_up, round2
from ..functions.text import fold_key, quoted
from .aggregate import numeric_bundle
from .cells import blank_of, is_temporal, is_text, key_of, number_of, row_order, shared, text_of
from .conditions import apply_filter
from .numbering import number_rows, running_total
from .quantiles import exact_quantiles
from .ranking import top_with_ties
from .sums import add_up, bin_sums, exact_sums, merged_sums, with_bin

# How much of a dataset is shown.
POINT_CAP = 2000
POSITION_CELLS = 65536
DOTS_PER_GROUP = 50
PANEL_CAP = 12
SUBGROUP_CAP = 8
UNIT_BIN_RANGE = 20
TARGET_BINS = 10
PARETO_PERCENT = 80
SMALL_SHARE_PERCENT = 2


@dataclass(frozen=True)
class Categorical:
    """``points(label, value, n, first)`` with what was left out.

    ``is_time`` is decided inside the plan: a date column, or every label reads as a
    period.  ``total`` is the cohort behind a count, a one-row table; it stays the
    whole cohort when points are later cut or folded.
    """

    points: DataFrame
    how: str
    is_time: Column
    no_data: DataFrame
    unreadable_periods: DataFrame
    total: DataFrame


def categorical(
    df: DataFrame, label: str, order_by, value: str | None = None, how: str = "count",
    bucket: str | None = None, chosen=None,
) -> Categorical:
    """Count, sum, average or median per label, optionally per month or quarter.

    An average or median group without a readable number is named in ``no_data``
    and not plotted; a sum group stays at 0.
    """
    if how != "count" and value is None:
        raise ValueError(f"{how} needs a value column")
    rows = apply_filter(df, chosen).filter(~blank_of(df, label))
    typed = is_temporal(df, label)
    raw = text_of(df, label)
    if bucket:
        shown = period_label_typed(quoted(label), bucket) if typed else period_label(quoted(label), bucket)
    else:
        shown = raw
    key = fold_key(shown) if bucket or is_text(df, label) else shown
    keyed = rows.select(
        key.alias("key"), shown.alias("label"), raw.alias("raw"), row_order(order_by).alias("first"),
        (number_of(df, value) if value else F.lit(None).cast("double")).alias("x"),
    )
    periods = keyed.filter(F.col("label").isNull()).select(F.col("raw").alias("value")).distinct()
    keyed = keyed.filter(F.col("label").isNotNull())
    spelled = shared(with_bin(keyed, "x").groupBy("key", "label", "__bin").agg(
        *bin_sums("x"), F.count(F.lit(1)).alias("rows"), F.min("first").alias("first"),
    ))
    by_bin = spelled.groupBy("key", "__bin").agg(
        *merged_sums(), F.sum("rows").alias("rows"), F.sum("__some").alias("n"), F.min(F.struct("first", "label")).alias("seen"),
    )
    groups = add_up(by_bin, ["key"], "total", rows=F.sum("rows"), n=F.sum("n"), seen=F.min("seen"))
    groups = groups.select("key", "seen.label", "rows", "n", F.coalesce("total", F.lit(0.0)).alias("total"), "seen.first")
    if how == "median":
        medians = exact_quantiles(keyed, ["key"], "x", {"median": 0.5})
        groups = groups.join(medians, "key", "left")
    is_time = F.lit(True) if typed else spelled.agg(
        F.coalesce(F.bool_and(looks_like_time(F.col("label"))), F.lit(False)).alias("t")
    ).scalar()
    number = {
        "count": lambda: F.col("rows").cast("double"), "sum": lambda: F.col("total"),
        "average": lambda: round2(F.col("total") / F.when(F.col("n") > 0, F.col("n"))), "median": lambda: round2(F.col("median")),
    }[how]()
    with_value = groups.withColumn("value", number)
    points = with_value.filter(F.col("value").isNotNull()).select("label", "value", "n", "first")
    return Categorical(
        points=points, how=how, is_time=is_time,
        no_data=with_value.filter(F.col("value").isNull()).select("label"),
        unreadable_periods=periods, total=groups.agg(F.sum("rows").alias("total")),
    )


def in_order(data: Categorical) -> DataFrame:
    """Points as a chart shows them: periods in time order, categories largest first.

    Periods keep first-seen order unless every label reads as a time.
    """
    return _ordered(data, F.desc, F.col("value"))


def _ordered(data: Categorical, way, key: Column) -> DataFrame:
    """Time axes by time, others by ``key``; ties by first sight."""
    at = time_order(F.col("label"))
    unread = data.points.agg(F.count_if(at.isNull())).scalar()
    marked = data.points.withColumns({
        "__at": F.when(data.is_time & (unread == 0), at), "__key": F.when(~data.is_time, key),
    })
    return marked.orderBy("__at", way("__key"), "first").drop("__at", "__key")


def sort_points(data: Categorical, mode: str = "value") -> DataFrame:
    """By label without case, or by value; a time axis is never re-ordered (O3)."""
    return _ordered(data, F.asc, F.lower("label")) if mode == "alpha" else in_order(data)


def cap_rank(data: Categorical, n: int | None, least: bool = False) -> Categorical:
    """The ``n`` largest or smallest categories, ties at the cut kept; a time axis whole (O2)."""
    return replace(data, points=top_with_ties(data.points, "value", n, least, data.is_time))


def fold_small(data: Categorical, percent: float = SMALL_SHARE_PERCENT) -> DataFrame:
    """Categories under ``percent`` of the total as one, where at least two are; never periods."""
    points = data.points
    total = points.agg(F.coalesce(F.sum(F.abs("value")), F.lit(0.0))).scalar()
    small = F.abs("value") / F.when(total != 0, total).otherwise(F.lit(1.0)) * 100 < percent
    marked = points.withColumn("small", small & ~data.is_time)
    folded = marked.agg(F.count_if("small")).scalar()
    other = F.col("small") & (folded >= 2)
    label = F.when(other, F.concat(F.lit("Other ("), folded.cast("string"), F.lit(" smaller groups)")))
    return marked.select(
        F.coalesce(label, F.col("label")).alias("label"), "value", other.alias("is_other"), F.when(~other, F.col("first")).alias("own"),
    ).groupBy("label", "is_other", "own").agg(F.sum("value").alias("value")).orderBy("is_other", F.desc("value")).select("label", "value")


def extreme(data: Categorical) -> DataFrame:
    """The leading category, if it leads alone among at least two.

    No row for a time axis, a tie, a single category or a median.
    """
    speaks = data.points.filter(~data.is_time) if data.how != "median" else data.points.limit(0)
    two = speaks.orderBy(F.desc("value"), "first").limit(2)
    best = two.agg(
        F.max_by("label", "value").alias("label"), F.max("value").alias("value"),
        F.min("value").alias("second"), F.count(F.lit(1)).alias("seen"),
    ).filter("seen = 2 AND value > second")
    total = data.total.scalar()
    percent = half_up(F.col("value") / total * 100).cast("long")
    verb = {"count": "Most common", "sum": "Highest total", "average": "Highest average"}.get(data.how, "")
    shown = F.concat(percent.cast("string"), F.lit("%")) if data.how == "count" else plain_number(F.col("value"))
    return best.select(
        "label", "value", F.concat(F.lit(verb + ": "), "label", F.lit(" ("), shown, F.lit(")")).alias("statement")
    )


def pareto(data: Categorical) -> DataFrame:
    """Running total and cumulative percent of a count, largest first.

    No row where it means nothing: not a count, a time axis, one category.
    """
    points = data.points.filter(~data.is_time) if data.how == "count" else data.points.limit(0)
    ranked = running_total(points, [F.desc("value"), F.asc("first")], "value", "cum_value", "position")
    total, seen = data.total.scalar(), ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.filter(seen >= 2).select(
        "position", "label", "value", "cum_value", (F.col("cum_value") / total * 100).alias("cum_pct")
    )


def pareto_summary(ranked: DataFrame) -> DataFrame:
    """The fewest categories that reach 80 percent, out of how many."""
    vital = ranked.agg(
        F.min(F.when(F.col("cum_pct") >= PARETO_PERCENT, F.struct("position", "cum_pct"))).alias("v"),
        F.count(F.lit(1)).alias("of"),
    ).filter("v IS NOT NULL")
    return vital.select(
        F.col("v.position").alias("k"), "of", half_up(F.col("v.cum_pct")).cast("long").alias("pct")
    )


def reference_line(data: Categorical) -> DataFrame:
    """The mean of the plotted values."""
    return data.points.agg(round2(F.avg("value")).alias("value"))


def scatter(df: DataFrame, x: str, y: str, order_by, chosen=None, cap: int = POINT_CAP) -> DataFrame:
    """Two number columns as points, evenly thinned to ``cap`` in row order.

    ``total_points`` says how many there were.  Position ``floor(i * n / cap)``
    is kept for i = 0 .. cap-1.
    """
    rows = apply_filter(df, chosen)
    at = row_order(order_by)
    points = rows.select(
        number_of(df, x).alias("x"), number_of(df, y).alias("y"), at.alias("at")
    ).filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    kind = points.schema["at"].dataType
    if isinstance(kind, T.NumericType):
        placed = _placed_by_cells(points, F.col("at").cast("double"), cap)
    elif isinstance(kind, (T.DateType, T.TimestampType)):
        placed = _placed_by_cells(points, F.unix_micros(F.col("at").cast("timestamp")).cast("double"), cap)
    else:
        placed = number_rows(points, [F.asc("at")], "position", start=0)
        placed = placed.withColumn("n", placed.agg(F.count(F.lit(1))).scalar())
    return placed.filter(_wanted_from(F.col("position"), F.col("n"), cap) == F.col("position")).select(
        "position", "x", "y", F.col("n").alias("total_points")
    )


def _wanted_from(position: Column, n: Column, cap: int) -> Column:
    """The first position at or after ``position`` that an even thinning keeps; null if there is none."""
    step = n.cast("double") / cap
    i = F.ceil(position / step)
    # Division may round up past the step that starts here.
    i = F.when((i > 0) & (F.floor((i - 1) * step) >= position), i - 1).otherwise(i)
    return F.when(n <= cap, position).when(i < cap, F.floor(i * step))


def _placed_by_cells(points: DataFrame, at: Column, cap: int) -> DataFrame:
    """Positions in the order of ``at`` for the cells of rows that hold a wanted position, and some others.

    Rows are counted in equal steps of the order, twice; only the few cells that hold
    wanted positions are sorted, so the table itself is never sorted or written.
    """
    def cell(value: Column, low: Column, high: Column, parts: int) -> Column:
        inside = F.floor((value - low) / (high - low) * parts).cast("int")
        return F.when(high > low, F.least(inside, F.lit(parts - 1))).otherwise(F.lit(0))

    points = points.withColumn("a", F.coalesce(at, F.lit(float("-inf"))))
    known = F.when(F.col("a") != float("-inf"), F.col("a"))
    facts = points.agg(F.struct(F.min(known).alias("low"), F.max(known).alias("high"), F.count(F.lit(1)).alias("n")).alias("f")).scalar()
    first = points.withColumn("f", facts).select(
        "x", "y", "at", "a", F.col("f.n").alias("n"),
        F.when(known.isNotNull(), cell(F.col("a"), F.col("f.low"), F.col("f.high"), POSITION_CELLS)).otherwise(F.lit(-1)).alias("c1"),
    )
    before = Window.orderBy("c1").rowsBetween(Window.unboundedPreceding, -1)
    counts = first.groupBy("c1").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.min("a").alias("low"), F.max("a").alias("high"))
    counts = counts.withColumn("below", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    holds = _wanted_from(F.col("below"), F.col("n"), cap) < F.col("below") + F.col("rows")
    # At most one row per cell of the first cut.
    kept = F.broadcast(counts.filter(holds).select("c1", "low", "high", "below"))
    second = first.join(kept, "c1").withColumn("c2", cell(F.col("a"), F.col("low"), F.col("high"), POSITION_CELLS // 64))
    inner = Window.partitionBy("c1").orderBy("c2").rowsBetween(Window.unboundedPreceding, -1)
    finer = second.groupBy("c1", "c2").agg(F.count(F.lit(1)).alias("rows"), F.first("n").alias("n"), F.first("below").alias("below"))
    finer = finer.withColumn("start", F.col("below") + F.coalesce(F.sum("rows").over(inner), F.lit(0)))
    holds = _wanted_from(F.col("start"), F.col("n"), cap) < F.col("start") + F.col("rows")
    # At most one row per kept point.
    exact = second.drop("below").join(F.broadcast(finer.filter(holds).select("c1", "c2", "start")), ["c1", "c2"])
    inside = Window.partitionBy("c1", "c2").orderBy("at")
    return exact.select("x", "y", "n", (F.col("start") + F.row_number().over(inside) - 1).alias("position"))


# --- crosstab ------------------------------------------------------------------------


@dataclass(frozen=True)
class Crosstab:
    """``cells(key, label, slot, subgroup, value)``, every key with every slot.

    ``labels(key, label, rows, first)`` orders the categories; at most eight slots.
    """

    cells: DataFrame
    labels: DataFrame
    slots: DataFrame


def crosstab(
    df: DataFrame, label: str, subgroup: str, order_by, value: str | None = None, how: str = "count", chosen=None,
    subgroups_shown: int = SUBGROUP_CAP,
) -> Crosstab:
    """Label by subgroup; beyond eight subgroups the seven largest and one Other."""
    rows = apply_filter(df, chosen).filter(~blank_of(df, label) & ~blank_of(df, subgroup))
    keyed = rows.select(
        key_of(df, label).alias("lk"), text_of(df, label).alias("lv"), key_of(df, subgroup).alias("sk"),
        text_of(df, subgroup).alias("sv"), row_order(order_by).alias("first"),
        (number_of(df, value) if value else F.lit(None).cast("double")).alias("x"),
    )
    spelled = keyed.groupBy("lk", "lv", "sk", "sv").agg(
        F.count(F.lit(1)).alias("rows"), F.count("x").alias("n"), F.min("first").alias("first"),
    )
    by_key = lambda k, v: spelled.groupBy(k).agg(
        F.min_by(v, "first").alias("label"), F.sum("rows").alias("rows"), F.min("first").alias("first")
    )
    labels, subgroups = by_key("lk", "lv"), by_key("sk", "sv")
    largest = subgroups.orderBy(F.desc("rows"), "first").limit(subgroups_shown)
    ranked = largest.withColumn("slot", F.row_number().over(Window.orderBy(F.desc("rows"), "first")) - 1)
    found = subgroups.agg(F.count(F.lit(1))).scalar()
    last = F.when(F.col("found") > subgroups_shown, subgroups_shown - 1).otherwise(subgroups_shown)
    own = ranked.withColumn("found", found).filter(F.col("slot") < last)
    other_name = F.concat(
        F.lit("Other ("), (F.col("found") - subgroups_shown + 1).cast("string"), F.lit(" smaller groups)")
    )
    slots = own.select("slot", F.col("label").alias("subgroup")).unionByName(
        ranked.withColumn("found", found).filter((F.col("found") > subgroups_shown) & (F.col("slot") == subgroups_shown - 1))
        .select("slot", other_name.alias("subgroup"))
    )
    slot_of = F.broadcast(own.select("sk", "slot"))  # at most eight rows
    other_slot = F.coalesce(F.col("slot"), F.lit(subgroups_shown - 1))
    merged = spelled.join(slot_of, "sk", "left").groupBy("lk", other_slot.alias("slot")).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n")
    )
    if how != "count":
        slotted = keyed.filter(F.col("x").isNotNull()).join(slot_of, "sk", "left").select("lk", other_slot.alias("slot"), "x")
        at = ["lk", "slot"]
        measured = exact_quantiles(slotted, at, "x", {"median": 0.5}) if how == "median" else exact_sums(slotted, at, "x", "total")
        merged = merged.join(measured, at, "left")
    number, empty = {
        "count": lambda: (F.col("rows").cast("double"), F.lit(0.0)), "sum": lambda: (F.coalesce("total", F.lit(0.0)), F.lit(0.0)),
        "average": lambda: (round2(F.col("total") / F.when(F.col("n") > 0, F.col("n"))), F.lit(None).cast("double")),
        "median": lambda: (round2(F.col("median")), F.lit(None).cast("double")),
    }[how]()
    n_slots = slots.agg(F.count(F.lit(1))).scalar()
    grid = labels.select("lk", "label", F.explode(F.sequence(F.lit(0), (n_slots - 1).cast("int"))).alias("slot"))
    cells = grid.join(merged.select("lk", "slot", number.alias("value")), ["lk", "slot"], "left").join(
        F.broadcast(slots), "slot"
    ).select(F.col("lk").alias("key"), "label", "slot", "subgroup", F.coalesce("value", empty).alias("value"))
    return Crosstab(cells, labels.select(F.col("lk").alias("key"), "label", "rows", "first"), slots)


def small_multiples(data: Crosstab, panels: int = PANEL_CAP) -> DataFrame:
    """The largest categories as panels with one shared scale."""
    largest_labels = data.labels.orderBy(F.desc("rows"), "first").limit(panels)
    shown = data.cells.join(F.broadcast(largest_labels.select("key", "rows")), "key")
    largest = shown.agg(F.max("value")).scalar()
    categories = data.labels.agg(F.count(F.lit(1))).scalar()
    return shown.select(
        "label", "rows", "slot", "subgroup", "value", largest.alias("max_value"),
        F.greatest(categories - panels, F.lit(0)).alias("hidden"),
    )


# --- distributions ----------------------------------------------------------------------


def histogram(df: DataFrame, value: str, chosen=None) -> DataFrame:
    """Counts per bin, empty bins kept: ``bin, from, to, n, width``.

    Whole numbers in a range up to 20 get a bin each; anything else gets bins of
    1, 2, 5 or 10 times a power of ten.
    """
    rows = apply_filter(df, chosen).select(number_of(df, value).alias("x")).filter("x IS NOT NULL")
    facts = rows.agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.bool_and(F.col("x") == F.floor("x")).alias("whole")
    ).filter("lo IS NOT NULL")
    spread = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(F.lit(1.0))
    raw = spread / TARGET_BINS
    power = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    nice = F.when(raw / power < 1.5, 1.0).when(raw / power < 3, 2.0).when(raw / power < 7, 5.0).otherwise(10.0)
    unit = F.col("whole") & (F.col("hi") - F.col("lo") <= UNIT_BIN_RANGE)
    plan = facts.withColumn("width", F.when(unit, F.lit(1.0)).otherwise(nice * power)).withColumns({
        "start": F.when(unit, F.col("lo")).otherwise(F.floor(F.col("lo") / F.col("width")) * F.col("width")),
        "end": F.when(unit, F.col("hi") + 1).otherwise(F.ceil(F.col("hi") / F.col("width")) * F.col("width")),
    }).withColumn(
        "bins", F.greatest(F.lit(1), half_up((F.col("end") - F.col("start")) / F.col("width")).cast("int"))
    )
    layout = plan.select(F.struct("start", "width", "bins")).scalar()
    placed = rows.withColumn("p", layout).select(
        F.least(F.floor((F.col("x") - F.col("p.start")) / F.col("p.width")).cast("int"), F.col("p.bins") - 1).alias("bin")
    )
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    edges = plan.select("start", "width", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin"))
    low = F.col("start") + F.col("bin") * F.col("width")
    return edges.join(counts, "bin", "left").select(
        "bin", low.alias("from"), (low + F.col("width")).alias("to"),
        F.coalesce("n", F.lit(0)).alias("n"), "width",
    ).orderBy("bin")


def histogram_left_out(df: DataFrame, value: str, chosen=None) -> DataFrame:
    """Filled cells a histogram could not read."""
    rows = apply_filter(df, chosen)
    return rows.agg(
        F.count_if(~blank_of(df, value) & number_of(df, value).isNull()).alias("unreadable"),
        F.count(number_of(df, value)).alias("n"),
    )


def box_dot(df: DataFrame, label: str, value: str, order_by, chosen=None, dots_shown: int = DOTS_PER_GROUP) -> DataFrame:
    """Full statistics per group, highest median first; raw values only up to ``dots_shown``.

    The values are cut to one more per group in every task before they move, so no
    task ever holds a large group; a larger group shows its box only.
    """
    rows = apply_filter(df, chosen).filter(~blank_of(df, label)).select(
        key_of(df, label).alias("key"), text_of(df, label).alias("label"), row_order(order_by).alias("first"),
        number_of(df, value).alias("x"),
    )
    spelled = rows.groupBy("key", "label").agg(F.min("first").alias("first"))
    labels = spelled.groupBy("key").agg(F.min_by("label", "first").alias("label"), F.min("first").alias("first"))
    readable = rows.filter("x IS NOT NULL")
    stats = numeric_bundle(readable, ["key"], "x")
    head = Window.partitionBy("key").orderBy("first")
    dots = readable.withColumn("rn", F.row_number().over(head)).filter(F.col("rn") <= dots_shown + 1).groupBy(
        "key"
    ).agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "x"))), lambda d: d["x"]).alias("values"))
    return labels.join(stats, "key").join(dots, "key").select(
        "label", "n", "average", "stdev", "median", "q1", "q3", "iqr", "min", "max", "range",
        F.when(F.col("n") <= dots_shown, F.col("values")).alias("values"), "first",
    ).orderBy(F.desc("median"), "first")


def box_dot_no_data(df: DataFrame, label: str, value: str, chosen=None) -> DataFrame:
    """Groups a box plot leaves out for want of a readable number."""
    rows = apply_filter(df, chosen).filter(~blank_of(df, label))
    return rows.groupBy(key_of(df, label).alias("label")).agg(F.count(number_of(df, value)).alias("n")).filter(
        "n = 0"
    ).select("label")
