"""The data-quality scan (Q1-Q16, Q20).

A sketch per column tells columns of few values, whose distinct cell values
``(column, value, n)`` make one table with a single shuffle, from those of many (free
text, ids), whose cells are judged in the scan and counted by digests.  Whole-row and
per-id checks need their own grouping.
Findings are rows ``table, column, type, count, detail, fix, param``.  ``fix`` is
null where nothing can be fixed; ``param`` names what the fix still needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import ISO_PREFIX, SLASH_DATE, is_calendar_date, slash_parts
from ..functions.names import AGE_NAME, END_NAME, NEVER_NEGATIVE, START_NAME, id_role
from ..functions.numbers import EPOCH_DATE, LIMIT_LOOSE, MONEY_NOISE, NOT_DONE, NUMBER, NUMBER_UNIT, is_number_text
from ..functions.text import entity_key, fold_key, is_blank, is_marker, quoted, split_list, trimmed
from ..session import cut_lineage
from .cells import blank_of, cells, is_temporal, is_text, key_of, row_order, shared, text_of
from .joins import off_vocabulary
from .rows import content_digest
from .profile import DATE, MIXED, NUMBER_TYPE, TEXT, class_counts, class_of, declared_types, value_frequencies

# Thresholds of the detectors and the units looked for.
ID_MIN_VALUES = 4
ID_MIN_UNIQUE = 0.9
CLOSED_MAX_LABELS = 4
UNIT_MIN_SHARE = 0.6
LIST_MAX_MEAN_LENGTH = 40
MAX_AGE = 120
SAMPLES = 5
ROW_SAMPLES = 3
CATEGORY = 10_000
LEAST_MANY = 50
SENT_KEYS = 200_000
UNIT_WORD = r"(?i)\b(kg|g|mg|mcg|ug|ml|l|lb|lbs|oz|cm|mm|in)\b"

FINDING = ["table", "column", "type", "count", "detail", "fix", "param"]


def _finding(kind: str, count: Column, detail: Column | None = None, fix: Column | None = None,
             param: Column | None = None) -> Column:
    text = lambda c: (c if c is not None else F.lit(None)).cast("string")
    return F.struct(
        F.lit(kind).alias("type"), count.cast("long").alias("count"), text(detail).alias("detail"),
        text(fix).alias("fix"), text(param).alias("param"),
    )


def _rows(df: DataFrame, table: str, column: Column, *findings: Column) -> DataFrame:
    found = df.select(column.alias("column"), F.explode(F.array(*findings)).alias("f")).filter("f.count > 0")
    return found.select(F.lit(table).alias("table"), F.col("column").cast("string"), "f.*")


def _named(names: list[str]) -> Column:
    return F.col("column").isin(*names) if names else F.lit(False)


# --- facts per column --------------------------------------------------------------


def column_facts(df: DataFrame, values: DataFrame, columns: list[str], today: str) -> DataFrame:
    """One row per column with every count the cell detectors decide from.

    ``values`` is the table of distinct cell values; each rule runs once per
    distinct value and is weighted by how often the value occurs.
    """
    c, n = F.col, F.col("n")
    flagged = _flagged(values, today)
    distinct = [F.count_if(~c("blank")).alias("distinct"), F.count_if(~c("blank") & (n > 1)).alias("repeated")]
    facts = flagged.groupBy("column").agg(*_fact_counts(), *distinct)
    label = F.when(~c("blank") & ~c("marker"), c("low"))
    labels = flagged.select("column", label.alias("low")).groupBy("column").agg(F.count_distinct("low").alias("labels"))
    return facts.join(F.broadcast(labels), "column", "left").withColumn("class", class_of(declared_types(df, columns)))


def _flagged(values: DataFrame, today: str) -> DataFrame:
    """What the rules say of each ``value``, which occurs ``n`` times."""
    v, n = F.col("value"), F.col("n")
    t = trimmed(v)
    slash = t.rlike(SLASH_DATE) & ~t.rlike(ISO_PREFIX)
    a, b, year = (F.when(slash, part) for part in slash_parts(v))
    limited = t.rlike(LIMIT_LOOSE) | t.rlike(NOT_DONE)
    number = F.coalesce(is_number_text(v) & ~is_blank(v), F.lit(False))
    unit = F.lower(F.regexp_extract(v, UNIT_WORD, 1))
    with_unit = (unit != "") & v.rlike("[0-9]")
    as_double = F.when(v.rlike(NUMBER), v.try_cast("double"))
    return values.select(
        "column", "value", "n",
        F.coalesce(slash, F.lit(False)).alias("slash"), a.alias("a"), b.alias("b"),
        is_calendar_date(year, a, b).alias("mdy"), is_calendar_date(year, b, a).alias("dmy"),
        F.coalesce(v.rlike(EPOCH_DATE), F.lit(False)).alias("epoch"),
        (number & v.rlike(MONEY_NOISE)).alias("noisy"), number.alias("number"),
        F.coalesce(limited & ~is_blank(v), F.lit(False)).alias("limited"),
        is_marker(v).alias("marker"), is_blank(v).alias("blank"),
        (F.size(split_list(v)) > 1).alias("listed"), F.length(v).alias("len"),
        F.coalesce(with_unit, F.lit(False)).alias("with_unit"), unit.alias("unit"),
        as_double.alias("x"), F.coalesce(F.substring(v, 1, 10) > F.lit(today), F.lit(False)).alias("future"),
        entity_key(v).alias("low"),
    )


def _fact_counts() -> list[Column]:
    """The counts over flagged values that need no look at another value."""
    v, n, c = F.col("value"), F.col("n"), F.col
    count = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0))
    return [
        *class_counts(), count(c("blank")).alias("blank"),
        F.bool_and(F.when(~c("blank") & ~c("marker"), c("number"))).alias("all_numbers"),
        count(c("slash")).alias("slash"), count(c("slash") & c("mdy")).alias("mdy"),
        count(c("slash") & c("dmy")).alias("dmy"),
        F.coalesce(F.bool_or(c("slash") & (c("a") > 12)), F.lit(False)).alias("day_first"),
        F.coalesce(F.bool_or(c("slash") & (c("b") > 12)), F.lit(False)).alias("day_second"),
        count(c("epoch")).alias("epoch"), count(c("noisy")).alias("noisy"),
        count(c("limited")).alias("limited"), count(c("number") & ~c("limited")).alias("plain_numbers"),
        count(~c("blank") & ~c("limited") & ~c("number") & ~c("marker")).alias("other_text"),
        count(c("listed")).alias("listed"), F.sum(c("len") * n).alias("length"),
        count(v.isNotNull()).alias("not_null"),
        count(c("with_unit")).alias("with_unit"),
        F.array_sort(F.collect_set(F.when(c("with_unit"), c("unit")))).alias("units"),
        count(c("x") < 0).alias("negative"), count(c("x") > MAX_AGE).alias("over_age"),
        count(c("future")).alias("future"),
    ]


# --- columns of many values ----------------------------------------------------------


def many_valued(df: DataFrame, columns: list[str], most: int = CATEGORY) -> list[str]:
    """Columns with more than about ``most`` (and ``LEAST_MANY``) different values, by one mergeable sketch per column.

    Either way of counting gives the same findings; the sketch only says which one moves less.
    """
    seen = lambda c: entity_key(quoted(c)) if is_text(df, c) else quoted(c)
    found = df.agg(*[F.approx_count_distinct(seen(c), 0.05).alias(f"c{i}") for i, c in enumerate(columns)]).head()
    return [c for c, n in zip(columns, found) if n > max(most, LEAST_MANY)]


@dataclass(frozen=True)
class Wide:
    """Cells of columns with many values: ``facts`` per column, and the spellings ``value, n, first`` of keys that have several."""

    facts: DataFrame
    spelled: DataFrame


def wide_facts(df: DataFrame, columns: list[str], order_by, today: str) -> Wide:
    """The facts of columns with many values, which never move as text.

    The rules run in the scan and their counts combine in every task.  Values are
    counted by the digest of their folded key, with the least and the greatest digest of its
    spellings: where these differ, the key has several, and only its cells are looked
    at again.  A column of more than ``LEAST_MANY`` values is no closed set of labels.
    """
    raw = cells(df, columns, first=row_order(order_by)).withColumn("n", F.lit(1).cast("long"))
    facts = _flagged(raw, today).groupBy("column").agg(*_fact_counts())
    v = F.col("value")
    keyed = raw.filter(~is_blank(v)).withColumn("key", F.xxhash64(fold_key(v)))
    keys = shared(keyed.groupBy("column", "key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.xxhash64(v)).alias("least"), F.max(F.xxhash64(v)).alias("greatest")
    ))
    one = F.col("least") == F.col("greatest")
    several = cut_lineage(keys.filter(~one).select("column", "key"))
    # A table of digests, whose size is checked before it is sent to every executor.
    small = several.count() <= SENT_KEYS
    spelled = cut_lineage(keyed.join(F.broadcast(several) if small else several, ["column", "key"]).groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), F.min("first").alias("first")
    ))
    counts = keys.groupBy("column").agg(F.count_if(one).alias("d"), F.count_if(one & (F.col("n") > 1)).alias("r")).unionByName(
        spelled.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("n") > 1).alias("r"))
    ).groupBy("column").agg(F.sum("d").alias("distinct"), F.sum("r").alias("repeated"))
    whole = facts.join(F.broadcast(counts), "column", "left").fillna(0, ["distinct", "repeated"])
    return Wide(whole.withColumn("labels", F.col("distinct")).withColumn("class", class_of(declared_types(df, columns))), spelled)


def cell_findings(facts: DataFrame, table: str, id_columns: list[str], columns: list[str]) -> DataFrame:
    """Findings that follow from one column's facts alone (Q5-Q10, Q12-Q15)."""
    c = F.col
    soft = ~c("class").isin(NUMBER_TYPE, DATE)  # neither all numbers nor all dates
    closed = (F.coalesce(c("labels"), F.lit(0)).between(1, CLOSED_MAX_LABELS)) & ~F.coalesce(c("all_numbers"), F.lit(True))
    markers = F.when(closed, F.lit(0)).otherwise(c("markers"))
    conflict = c("day_first") == c("day_second")
    order = F.when(c("day_first") & ~c("day_second"), F.lit("DMY")).otherwise(F.lit("MDY"))
    valid = F.when(order == "DMY", c("dmy")).otherwise(c("mdy"))
    text_numbers = F.when(c("class") == MIXED, c("numbers") + c("noisy")).otherwise(c("noisy"))
    unique = c("distinct") / F.when(c("filled") > 0, c("filled"))
    when = lambda test, count: F.when(F.coalesce(test, F.lit(False)), count).otherwise(F.lit(0))
    return _rows(
        facts, table, c("column"),
        _finding("duplicateIds", when(
            ~_named(id_columns) & (c("filled") >= ID_MIN_VALUES) & (unique >= ID_MIN_UNIQUE), c("repeated"))),
        _finding("missing", c("blank") + markers, F.when(markers > 0, F.lit("markers")).otherwise(F.lit("empty")),
                 F.when(markers > 0, F.lit("blank_markers"))),
        _finding("textNumbers", when(soft, text_numbers), None, F.lit("number_text")),
        _finding("textDates", when(c("class") != NUMBER_TYPE, valid),
                 F.concat((c("slash") - valid).cast("string"), F.lit(" unreadable")), F.lit("parse_date"),
                 F.when(conflict, F.lit("order?")).otherwise(order)),
        _finding("epochDates", when(soft & (c("numbers") > 0) & (c("numbers") >= c("epoch")), c("epoch")), None,
                 F.lit("epoch_serial")),
        _finding("impossible", when(_named([x for x in columns if NEVER_NEGATIVE.search(x)]), c("negative")),
                 F.lit("negative")),
        _finding("impossible", when(_named([x for x in columns if AGE_NAME.search(x)]), c("over_age")),
                 F.lit("age over 120")),
        _finding("impossible", when(c("class") == DATE, c("future")), F.lit("in the future")),
        _finding("censored", when(
            (c("class") != DATE) & ((c("plain_numbers") >= c("limited")) | (c("other_text") == 0)), c("limited")),
            None, F.lit("censored"), F.lit("policy?")),
        _finding("multiValue", when(
            soft & (c("listed") >= 2) & (c("length") / c("not_null") <= LIST_MAX_MEAN_LENGTH), c("listed")),
            None, F.lit("split_rows")),
        _finding("mixedUnits", when(soft & (F.size("units") >= 2), c("with_unit")), F.array_join("units", ", ")),
    )


def unit_suffixes(values: DataFrame, facts: DataFrame, table: str) -> DataFrame:
    """Numbers with a unit word, where one word has most of them (Q10)."""
    unit = F.lower(F.regexp_extract(trimmed(F.col("value")), NUMBER_UNIT, 2))
    per_unit = values.select("column", F.when(unit != "", unit).alias("unit"), "n").groupBy("column", "unit").agg(
        F.sum("n").alias("n")
    )
    with_unit = F.when(F.col("unit").isNotNull(), F.col("n"))
    total = per_unit.groupBy("column").agg(
        F.sum(with_unit).alias("total"), F.max(with_unit).alias("most"), F.max_by("unit", with_unit).alias("unit")
    ).filter((F.col("total") >= 2) & (F.col("most") / F.col("total") >= UNIT_MIN_SHARE))
    soft = facts.filter(~F.col("class").isin(NUMBER_TYPE, DATE)).select("column")
    return _rows(
        total.join(F.broadcast(soft), "column"), table, F.col("column"),
        _finding("unitSuffixNumbers", F.col("total"), F.col("unit"), F.lit("strip_unit")),
    )


def variant_map(values: DataFrame, few: DataFrame) -> DataFrame:
    """``column, raw, canonical`` for spellings that fold together (Q11).

    The most common spelling wins, the first seen on a tie.  The window holds the
    spellings of one key of one column.
    """
    key = F.xxhash64(F.when(~is_blank(F.col("value")), fold_key(F.col("value"))))
    spelled = shared(values.join(F.broadcast(few), "column").filter(~is_blank(F.col("value"))).withColumn("key", key))
    digest = F.xxhash64("value")
    several = spelled.groupBy("column", "key").agg(F.min(digest).alias("least"), F.max(digest).alias("greatest"))
    several = several.filter("least <> greatest").select("column", "key")
    folded = spelled.join(several, ["column", "key"]).withColumn("folded", fold_key(F.col("value")))
    by_key = Window.partitionBy("column", "folded")
    best = by_key.orderBy(F.desc("n"), F.asc("first"))
    return folded.select(
        "column", F.col("value").alias("raw"), F.first("value").over(best).alias("canonical"), "n",
        F.count("folded").over(by_key).alias("spellings"),
    ).filter("spellings > 1")


def few_valued(facts: DataFrame, most: int | None = None) -> DataFrame:
    """Category-like columns: not numbers or dates, and with at most ``most`` distinct values if that is given."""
    few = F.lit(True) if most is None else F.col("distinct") <= most
    return facts.filter(few & ~F.col("class").isin(NUMBER_TYPE, DATE)).select("column")


def variant_findings(variants: DataFrame, table: str) -> DataFrame:
    merged = variants.groupBy("column").agg(F.count_if(F.col("raw") != F.col("canonical")).alias("merges"))
    return _rows(merged, table, F.col("column"),
                 _finding("categoryVariants", F.col("merges"), None, F.lit("merge_spellings"), F.lit("map")))


# --- whole rows and ids ----------------------------------------------------------------


def duplicate_rows(df: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """Extra copies of whole rows (Q1)."""
    copies = df.groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    extra = copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("extra"))
    return _rows(extra, table, F.lit(None), _finding("duplicateRows", F.col("extra"), None, F.lit("dedupe_rows")))


def id_groups(df: DataFrame, column: str, columns: list[str]) -> DataFrame:
    """Per filled id: its rows and its distinct rows.

    Exact copies collapse before the second grouping, so an id that holds most
    of the rows costs its distinct rows and no task sorts them.
    """
    copies = df.filter(~blank_of(df, column)).groupBy(*[quoted(c) for c in columns]).agg(F.count(F.lit(1)).alias("n"))
    return copies.groupBy(trimmed(quoted(column)).alias("id")).agg(
        F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct_rows")
    )


def encounter_findings(df: DataFrame, table: str, column: str, columns: list[str]) -> DataFrame:
    """Encounter ids on several rows; copies can go, differing rows need a person (Q3)."""
    facts = id_groups(df, column, columns).agg(
        F.count_if(F.col("rows") > 1).alias("ids"),
        F.coalesce(F.sum(F.col("rows") - F.col("distinct_rows")), F.lit(0)).alias("copies"),
        F.count_if(F.col("distinct_rows") > 1).alias("differing"),
    )
    detail = F.concat(F.col("copies").cast("string"), F.lit(" copies, "),
                      F.col("differing").cast("string"), F.lit(" differing"))
    return _rows(facts, table, F.lit(column), _finding(
        "duplicateEncounterIds", F.col("ids"), detail, F.when(F.col("copies") > 0, F.lit("dedupe_encounters"))))


def differing_rows(df: DataFrame, column: str, columns: list[str], order_by, ids: int = 5, rows: int = 4) -> DataFrame:
    """A few repeated ids whose rows differ, with a few rows each (Q3)."""
    first = df.filter(~blank_of(df, column)).groupBy(*[quoted(c) for c in columns]).agg(
        F.min(row_order(order_by)).alias("__at")
    )
    groups = first.groupBy(trimmed(quoted(column)).alias("__id")).agg(
        F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first")
    ).filter("__n > 1").orderBy("__first").limit(ids).select("__id")
    shown = df.join(F.broadcast(groups), trimmed(quoted(column)) == F.col("__id"))
    window = Window.partitionBy("__id").orderBy(row_order(order_by))
    return shown.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= rows).drop("__rn", "__id")


def patient_findings(df: DataFrame, table: str, column: str, columns: list[str]) -> DataFrame:
    """Patients on several distinct rows, with the ways to keep one (Q4)."""
    facts = id_groups(df, column, columns).agg(F.count_if(F.col("distinct_rows") > 1).alias("ids"))
    return _rows(facts, table, F.lit(column), _finding(
        "duplicatePatientIds", F.col("ids"), F.lit(" | ".join(survivor_policies(df, columns))), F.lit("keep_one"),
        F.lit("policy?")))


def survivor_policies(df: DataFrame, columns: list[str]) -> list[str]:
    """The row-survival policies a table offers, from its date-like columns."""
    dates = [c for c in columns if is_temporal(df, c) or "date" in c.lower()]
    by_date = [f"{way}::{d}" for d in dates for way in ("first", "last")]
    return [*(by_date or ["firstrow", "lastrow"]), "complete"]


def reversed_dates(df: DataFrame, table: str, columns: list[str], dates: list[str]) -> DataFrame | None:
    """Rows whose end date lies before its start date (Q12)."""
    start = next((c for c in columns if c in dates and START_NAME.search(c)), None)
    end = next((c for c in columns if c in dates and END_NAME.search(c)), None)
    if start is None or end is None or start == end:
        return None
    bad = df.agg(F.count_if(text_of(df, end) < text_of(df, start)).alias("bad"))
    return _rows(bad, table, F.lit(end), _finding("impossible", F.col("bad"), F.lit(f"before {start}")))


def grain_finding(df: DataFrame, table: str, entity: str) -> DataFrame:
    """Whether an entity repeats over rows, which makes a row count no entity count (Q20)."""
    key = F.when(~blank_of(df, entity), key_of(df, entity))
    facts = df.agg(F.count(key).alias("rows"), F.count_distinct(key).alias("entities"))
    extra = F.when(F.col("rows") > F.col("entities"), F.col("entities")).otherwise(F.lit(0))
    detail = F.concat(F.col("rows").cast("string"), F.lit(" rows, "), F.col("entities").cast("string"), F.lit(" entities"))
    return _rows(facts, table, F.lit(entity), _finding("repeating_entity", extra, detail))


def entity_column(facts: DataFrame, columns: list[str], named: str | None = None) -> str | None:
    """The entity column: by name, else the first nearly unique one with a repeat (Q20)."""
    from ..functions.names import name_key

    wanted = name_key(named).removesuffix("s") if named else None
    by_name = [c for c in columns if wanted and wanted in name_key(c)]
    if by_name:
        return by_name[0]
    unique = F.col("distinct") / F.when(F.col("filled") > 0, F.col("filled"))
    likely = facts.filter(
        (F.col("filled") >= ID_MIN_VALUES) & (unique >= ID_MIN_UNIQUE) & (F.col("distinct") < F.col("filled"))
    ).select("column")
    found = {r["column"] for r in likely.collect()}
    return next((c for c in columns if c in found), None)


def likely_grain(facts: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """The grain check of a table whose entity nobody names: its first nearly unique column with a repeat (Q20)."""
    place = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), F.lit(i))])
    likely = facts.filter(
        (F.col("filled") >= ID_MIN_VALUES) & (F.col("distinct") / F.col("filled") >= ID_MIN_UNIQUE)
        & (F.col("distinct") < F.col("filled"))
    )
    first = likely.agg(F.min(F.struct(
        F.element_at(place, F.col("column")).alias("place"), "column", "filled", "distinct"
    )).alias("e")).select("e.*")
    detail = F.concat(F.col("filled").cast("string"), F.lit(" rows, "), F.col("distinct").cast("string"), F.lit(" entities"))
    return _rows(first, table, F.col("column"), _finding("repeating_entity", F.col("distinct"), detail))


# --- the scan ------------------------------------------------------------------------------


def scan(
    df: DataFrame, table: str, order_by, vocab: DataFrame | None = None, today: str = "9999-12-31",
    entity: str | None = None, columns: list[str] | None = None, date_columns: list[str] | None = None, category: int = CATEGORY,
) -> DataFrame:
    """Every detector on one table (Q2).

    Columns of up to about ``category`` values are counted by value, the others by digests in the scan.

    ``today`` bounds future dates.  The grain check takes ``entity``, or the first
    column that looks like one.  Text columns that hold dates are named in ``date_columns`` for the start/end check.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = columns or [c for c in df.columns if c not in order]
    many = many_valued(df, columns, category)
    values = value_frequencies(df, [c for c in columns if c not in many], first=row_order(order_by)) if len(many) < len(columns) else None
    facts, counted, spelled = [], [], []
    if values is not None:
        facts.append(column_facts(df, values, columns, today))
        counted.append(values.select("column", "value", "n"))
        spelled.append(values.select("column", "value", "n", "first"))
    if many:
        wide = wide_facts(df, many, order_by, today)
        facts.append(wide.facts)
        counted.append(cells(df, many).withColumn("n", F.lit(1).cast("long")))
        spelled.append(wide.spelled.select("column", "value", "n", "first"))
    # One row per column, read by several detectors.
    facts = cut_lineage(reduce(lambda a, b: a.unionByName(b), facts))
    counted, spelled = (reduce(lambda a, b: a.unionByName(b), parts) for parts in (counted, spelled))
    id_columns = [c for c in columns if id_role(c)]
    dates = [c for c in columns if is_temporal(df, c) or c in (date_columns or [])]
    parts = [duplicate_rows(df, table, columns)]
    parts += [encounter_findings(df, table, c, columns) for c in columns if id_role(c) == "encounter"]
    parts += [patient_findings(df, table, c, columns) for c in columns if id_role(c) == "patient"]
    parts += [cell_findings(facts, table, id_columns, columns), unit_suffixes(counted, facts, table)]
    parts.append(variant_findings(variant_map(spelled, few_valued(facts)), table))
    backwards = reversed_dates(df, table, columns, dates)
    parts += [backwards] if backwards is not None else []
    if vocab is not None:
        parts.append(vocabulary_findings(df, table, vocab, columns))
    parts.append(grain_finding(df, table, entity) if entity else likely_grain(facts, table, columns))
    return reduce(DataFrame.unionByName, parts)


def vocabulary_findings(df: DataFrame, table: str, vocab: DataFrame, columns: list[str]) -> DataFrame:
    """Cells off their column's list of terms (Q16)."""
    off = off_vocabulary(df, vocab, columns).groupBy("column").agg(F.sum("n").alias("n"))
    return _rows(off, table, F.col("column"), _finding("notInPicklist", F.col("n")))


def scan_all(tables: dict[str, DataFrame], order_by, **options) -> DataFrame:
    """All tables scanned into one list of findings."""
    return reduce(DataFrame.unionByName, [scan(df, name, order_by, **options) for name, df in tables.items()])


def value_tests(today: str) -> list[tuple[str, str | None, Column]]:
    """(type, detail, test of ``value`` and its count ``n``) for the findings that single values cause."""
    v = F.col("value")
    number = is_number_text(v) & ~is_blank(v)
    as_double = F.when(v.rlike(NUMBER), v.try_cast("double"))
    return [
        ("missing", "markers", is_marker(v)), ("textNumbers", None, number),
        ("textDates", None, trimmed(v).rlike(SLASH_DATE) & ~trimmed(v).rlike(ISO_PREFIX)), ("epochDates", None, v.rlike(EPOCH_DATE)),
        ("censored", None, (trimmed(v).rlike(LIMIT_LOOSE) | trimmed(v).rlike(NOT_DONE)) & ~is_blank(v)),
        ("multiValue", None, F.size(split_list(v)) > 1), ("unitSuffixNumbers", None, trimmed(v).rlike(NUMBER_UNIT)),
        ("mixedUnits", None, (F.regexp_extract(v, UNIT_WORD, 1) != "") & v.rlike("[0-9]")),
        ("duplicateIds", None, ~is_blank(v) & (F.col("n") > 1)), ("impossible", "negative", as_double < 0),
        ("impossible", f"age over {MAX_AGE}", as_double > MAX_AGE), ("impossible", "in the future", F.substring(v, 1, 10) > F.lit(today)),
    ]


def row_samples(df: DataFrame, columns: list[str], order_by) -> DataFrame:
    """``column, type, samples``: examples behind the whole-row and id findings (Q1, Q3, Q4, Q5).

    Copied rows show their first three filled cells, three examples in the order in which
    their second copies come; at most two rows of a content leave a task.  Repeated ids show how often they come.
    """
    filled = F.filter(F.array(*[text_of(df, c) for c in columns]), lambda x: x.isNotNull())
    shown = F.array_join(F.slice(filled, 1, 3), " · ")
    window = Window.partitionBy(*content_digest(columns)).orderBy("first")
    rows = df.select(*[quoted(c) for c in columns], row_order(order_by).alias("first"), shown.alias("sample"))
    second = rows.withColumn("rn", F.row_number().over(window)).filter("rn <= 2").filter("rn = 2")
    parts = [_listed(second.select("sample", "first"), None, "duplicateRows", ROW_SAMPLES)]
    for c in columns:
        role = id_role(c)
        kind = {"encounter": "duplicateEncounterIds", "patient": "duplicatePatientIds"}.get(role)
        if kind:
            copies = df.filter(~blank_of(df, c)).groupBy(*[quoted(x) for x in columns]).agg(
                F.count(F.lit(1)).alias("__n"), F.min(row_order(order_by)).alias("__first")
            )
            times = F.sum("__n") if role == "encounter" else F.count(F.lit(1))
            ids = copies.groupBy(trimmed(quoted(c)).alias("id")).agg(times.alias("n"), F.min("__first").alias("first")).filter("n > 1")
            parts.append(_listed(ids.select(F.concat("id", F.lit(" ("), F.col("n").cast("string"), F.lit("×)")).alias("sample"), "first"), c, kind, SAMPLES))
    return reduce(DataFrame.unionByName, parts)


def _listed(found: DataFrame, column: str | None, kind: str, most: int) -> DataFrame:
    """The first ``most`` samples as one list."""
    top = found.orderBy("first").limit(most)
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "sample"))), lambda x: x["sample"]).alias("samples"))
    return listed.select(F.lit(column).cast("string").alias("__column"), F.lit(kind).alias("__type"), F.lit(None).cast("string").alias("why"), "samples")


def explained(findings: DataFrame, df: DataFrame, order_by, columns: list[str] | None = None, today: str = "9999-12-31") -> DataFrame:
    """``findings`` with ``fixable`` and ``samples``: up to five values that cause each, as seen first (Q2).

    Whole-row and id findings show examples as ``row_samples`` gives them; findings that
    compare columns have none.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = columns or [c for c in df.columns if c not in order]
    values = value_frequencies(df, columns, first=row_order(order_by))
    causes = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(kind).alias("type"), F.lit(detail).cast("string").alias("why"))) for kind, detail, test in value_tests(today)
    ]))
    caused = values.select("column", "value", "first", F.explode(causes).alias("c")).select("column", "value", "first", "c.*")
    window = Window.partitionBy("column", "type", "why").orderBy("first", "value")
    kept = caused.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= SAMPLES)
    listed = kept.groupBy(F.col("column").alias("__column"), F.col("type").alias("__type"), "why").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "value"))), lambda x: x["value"]).alias("samples")
    )
    listed = listed.unionByName(row_samples(df, columns, order_by))
    same = F.col("column").eqNullSafe(F.col("__column")) & (F.col("type") == F.col("__type")) & (
        F.col("why").isNull() | (F.col("detail") == F.col("why"))
    )
    return findings.join(listed, same, "left").select(
        *findings.columns, F.col("fix").isNotNull().alias("fixable"), "samples"
    )


def samples(df: DataFrame, columns: list[str], test, order_by) -> DataFrame:
    """Up to five distinct values per column for which ``test(value)`` holds, as seen first."""
    values = value_frequencies(df, columns, first=row_order(order_by)).filter(test(F.col("value")))
    window = Window.partitionBy("column").orderBy("first")
    return values.withColumn("rn", F.row_number().over(window)).filter(F.col("rn") <= SAMPLES).select(
        "column", F.col("rn").alias("place"), "value", "n"
    )
