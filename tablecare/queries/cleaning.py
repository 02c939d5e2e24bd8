"""Cell rewrites, duplicates, surviving rows, reshapes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, formats, numbers, text, units, words
from ..functions.masking import mask_string
from ..operators import reshape, rows
from ..operators.fixes import Fix, apply_cells
from .base import blank, derived, fold, missing, num, plain, r2, table, trim, with_tables

ORDERS = "messy_orders"


def _cells(column, expression, name="value"):
    """The row id, the cell and its rewritten value."""
    def run(spark, folder):
        return derived(spark, folder, ORDERS).select("row_id", expression(F.col(column)).alias(name))

    return run


def fix_variants(spark, folder):
    mapping = {"1-urgent": "1-URGENT", "2-high": "2-HIGH", "2-HIGH  ": "2-HIGH", "5-LOW  ": "5-LOW"}
    return derived(spark, folder, ORDERS).select("row_id", text.merge_spellings(F.col("priority"), mapping).alias("value"))


def apply_cell_fixes(spark, folder):
    fixes = [
        Fix("blank_markers", "amount"), Fix("strip_unit", "amount"), Fix("number_text", "amount"),
        Fix("censored", "amount", {"policy": "boundary"}), Fix("parse_date", "visit_date", {"order": "DMY"}),
    ]
    return apply_cells(derived(spark, folder, ORDERS), fixes).select("row_id", "amount", "visit_date")


def clean_scalars(spark, folder):
    df = derived(spark, folder, ORDERS)
    c = F.col
    return df.select(
        "row_id", text.fold_key(c("priority")).alias("folded"), text.column_key(c("priority")).alias("name_key"),
        numbers.to_number(c("amount")).alias("number"), text.is_missing(c("amount")).alias("missing"),
        F.size(text.split_list(c("tags"))).alias("items"), numbers.share(c("row_id") % 7, c("row_id") % 9).alias("share"),
        numbers.round2((c("row_id") % 1000 - 500) / 8).alias("half_up"),
    )


def date_ranks(spark, folder):
    return derived(spark, folder, ORDERS).select(
        "row_id", (dates.row_rank(F.col("visit_date")) / 86400000000).alias("day"), dates.row_rank(F.col("stay")).alias("stay")
    )


def period_labels(spark, folder):
    df = derived(spark, folder, ORDERS)
    month = dates.period_label(F.col("visit_date"), "month")
    return df.select(
        "row_id", month.alias("month"), dates.period_label(F.col("visit_date"), "quarter").alias("quarter"),
        dates.time_order(month).cast("string").alias("time_order"),
    )


def quantity_to_days(spark, folder):
    part = table(spark, folder, "part")
    said = F.concat(
        F.lit("over "), F.element_at(F.array(*[F.lit(w) for w in ("a", "two", "12", "2.5")]), (F.col("p_size") % 4 + 1).cast("int")),
        F.lit(" "), F.element_at(F.array(*[F.lit(w) for w in ("week", "hours", "months", "days", "years")]), (F.col("p_partkey") % 5 + 1).cast("int")),
    )
    q = units.parse_quantity(F.col("said"))
    return part.select("p_partkey", said.alias("said")).select(
        "p_partkey", "said", q["number"].alias("number"), q["unit"].alias("unit"), numbers.round2(q["days"]).alias("days"),
        q["approximate"].alias("approximate"), units.quantity_in_column_unit(q, "Wait_hours").alias("hours"),
        units.quantity_in_column_unit(q, "Wait").alias("unknown"),
    )


def report_formats(spark, folder):
    part, c = table(spark, folder, "part"), F.col
    return part.select(
        "p_partkey", formats.mean_sd(c("p_retailprice"), c("p_size").cast("double")).alias("mean_sd"),
        formats.median_iqr(c("p_size").cast("double"), c("p_retailprice"), F.lit(None).cast("double")).alias("median_iqr"),
        formats.n_percent(c("p_size"), F.lit(50)).alias("n_percent"), formats.bar_label(c("p_partkey"), F.lit(2000)).alias("bar"),
        formats.p_text(c("p_size") / 20000).alias("p_text"), units.duration_label(c("p_size"), "Stay_days").alias("stay"),
    )


def word_forms(spark, folder):
    said = F.explode(words.tokens(F.concat_ws(" ", "p_name", F.lit("diagnoses treated boxes categories glass paediatric travelled"))))
    named = table(spark, folder, "part").select(said.alias("word")).distinct()
    return named.select("word", words.fold_word(F.col("word")).alias("form"), words.fold_spelling(F.col("word")).alias("spelling"))


def short_forms(spark, folder):
    codes = ["E. coli", "MRSA", "C.Diff", "unknown bug"]
    said = F.element_at(F.array(*[F.lit(x) for x in codes]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    df = table(spark, folder, "supplier").select("s_suppkey", said.alias("said"))
    return df.select("s_suppkey", F.explode_outer(words.expand_short_form(F.col("said"))).alias("long_form"))


def masked_shapes(spark, folder):
    """Whether every mask keeps its value's shape; the masks themselves are random."""
    df = derived(spark, folder, ORDERS).filter("priority IS NOT NULL")
    shape = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    masked = mask_string(F.col("priority"), F.xxhash64("row_id"))
    return df.groupBy(shape(F.col("priority")).alias("shape")).agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(shape(masked) == shape(F.col("priority"))).alias("kept")
    )


def _keep_one(policy, side="kept"):
    def run(spark, folder):
        split = rows.keep_one(derived(spark, folder, ORDERS), "patient_id", policy, "row_id")
        return getattr(split, side).select("row_id", "patient_id")

    return run


def keep_one_repeated_order(spark, folder):
    """Kept and removed rows per status where a day is all the order there is: together they are the input."""
    df = derived(spark, folder, ORDERS).select("patient_id", "status", "visit_date")
    split = rows.keep_one(df, "patient_id", "firstrow", "visit_date")
    both = split.kept.withColumn("kept", F.lit(1)).unionByName(split.removed.withColumn("kept", F.lit(0)))
    return both.agg(F.sum("kept").alias("kept"), F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kept") == 0).alias("removed"))


def _visits(step, side):
    def run(spark, folder):
        df = derived(spark, folder, "copied_visits").withColumn("visit_id", F.col("visit_id").cast("string"))
        split = rows.dedupe_rows(df, "row_id") if step == "rows" else rows.dedupe_encounters(df, "visit_id", "row_id")
        return getattr(split, side)

    return run


def split_rows(spark, folder):
    return reshape.split_rows(derived(spark, folder, ORDERS), "tags").select("row_id", "tags")


def _paired(side):
    def run(spark, folder):
        return getattr(reshape.explode_paired(derived(spark, folder, ORDERS), "tags", "doses"), side).select("row_id", "tags", "doses")

    return run


def _wide(spark, folder):
    return reshape.long_to_wide(
        table(spark, folder, "events"), "user_id", "event_type", "value", "event_id",
        ["click", "error", "purchase", "signup", "view"],
    )


def long_to_wide(spark, folder):
    return _wide(spark, folder).rows


def long_to_wide_collisions(spark, folder):
    return _wide(spark, folder).collisions


def wide_to_long(spark, folder):
    return reshape.wide_to_long(derived(spark, folder, ORDERS), "row_id", ["priority", "amount", "tags"])


QUERIES = {
    "fix_numbers": _cells("amount", numbers.number_text), "fix_sentinels": _cells("amount", text.blank_markers),
    "fix_dates_dmy": _cells("visit_date", lambda c: dates.parse_date(c, "DMY")),
    "fix_dates_mdy": _cells("visit_date", lambda c: dates.parse_date(c, "MDY")),
    "fix_epoch": _cells("stay", numbers.epoch_serial), "fix_units": _cells("course_days", numbers.strip_unit),
    "fix_censored_boundary": _cells("amount", lambda c: numbers.censored(c, "boundary")),
    "fix_censored_missing": _cells("amount", lambda c: numbers.censored(c, "missing")),
    "fix_variants": fix_variants, "apply_cell_fixes": apply_cell_fixes, "clean_scalars": clean_scalars,
    "date_ranks": date_ranks, "period_labels": period_labels, "quantity_to_days": quantity_to_days,
    "report_formats": report_formats, "word_forms": word_forms, "short_forms": short_forms, "masked_shapes": masked_shapes,
    "keep_one_first": _keep_one("first::visit_date"), "keep_one_last": _keep_one("last::visit_date"),
    "keep_one_complete": _keep_one("complete"), "keep_one_firstrow": _keep_one("firstrow"),
    "keep_one_lastrow": _keep_one("lastrow"), "keep_one_removed": _keep_one("last::visit_date", "removed"),
    "keep_one_repeated_order": keep_one_repeated_order, "dedupe_rows": _visits("rows", "kept"), "dedupe_rows_removed": _visits("rows", "removed"),
    "dedupe_encounters": _visits("encounters", "kept"), "dedupe_encounters_removed": _visits("encounters", "removed"),
    "split_rows": split_rows, "paired_explode": _paired("rows"), "paired_mismatched": _paired("mismatched"),
    "long_to_wide": long_to_wide, "long_to_wide_collisions": long_to_wide_collisions, "wide_to_long": wide_to_long,
}

# --- the same in SQL ----------------------------------------------------------------------------

_CLEAN = "regexp_replace(amount, '[$,\\s]', '', 'g')"
_NUMBER_TEXT = f"CASE WHEN regexp_matches({_CLEAN}, '^-?\\d+(\\.\\d+)?$') THEN {_CLEAN} ELSE amount END"
_LIMIT = "'^([<>]=?)\\s*(-?\\d+(\\.\\d+)?)$'"


def _row(expression):
    return with_tables(f"SELECT row_id, {expression} AS value FROM messy_orders", ORDERS)


def _parsed(order):
    part = "regexp_extract(trim(visit_date), '^(\\d{1,2})[/-](\\d{1,2})[/-](\\d{4})$', "
    a, b, y = (f"{part}{i})" for i in (1, 2, 3))
    month, day = (b, a) if order == "DMY" else (a, b)
    read = f"try_strptime({y} || '-' || lpad({month}, 2, '0') || '-' || lpad({day}, 2, '0'), '%Y-%m-%d')"
    return f"CASE WHEN regexp_matches(visit_date, '^\\d{{4}}-') THEN visit_date ELSE coalesce(strftime({read}, '%Y-%m-%d'), visit_date) END"


_STRIPPED = "CASE WHEN regexp_matches(v1, '^-?\\d+(\\.\\d+)?\\s+[A-Za-z]+\\.?$') THEN regexp_extract(v1, '^-?\\d+(\\.\\d+)?') ELSE v1 END"
_QUARTER = "year || '-Q' || CAST(CAST(ceil(CAST(mo AS INTEGER) / 3.0) AS INTEGER) AS VARCHAR)"


def _survivors(order, keep=True):
    entity = f"CASE WHEN {blank('patient_id')} THEN 'row ' || CAST(row_id AS VARCHAR) ELSE lower({trim('patient_id')}) END"
    return with_tables(
        f"SELECT row_id, patient_id FROM (SELECT *, row_number() OVER (PARTITION BY {entity} ORDER BY {order}, row_id) AS rn "
        f"FROM messy_orders) WHERE rn {'=' if keep else '>'} 1", ORDERS)


_DAY = "try_strptime(visit_date, '%Y-%m-%d')"
_FILLED = " + ".join(
    f"CAST(NOT {blank(f'CAST({c} AS VARCHAR)')} AS INTEGER)"
    for c in ("patient_id", "priority", "second_priority", "status", "amount", "visit_date", "tags", "doses", "stay", "course_days")
)
_VISITS = "(SELECT row_id, CAST(visit_id AS VARCHAR) AS visit_id, customer, priority, note FROM copied_visits)"


def _visit_sql(apart, keep):
    return with_tables(
        f"SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY visit_id, customer, priority, note{apart} ORDER BY row_id) AS rn "
        f"FROM {_VISITS}) WHERE rn {'=' if keep else '>'} 1", "copied_visits")


_APART = ", CASE WHEN visit_id IS NULL THEN row_id END"


def _items(column):
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({column}, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '')"


_PAIRS = f"SELECT row_id, tags, doses, {_items('tags')} AS xs, {_items('doses')} AS ys FROM messy_orders"
_SHORT = "(len(xs) <= 1 AND len(ys) <= 1)"
_SAID = (
    "SELECT p_partkey, 'over ' || ['a', 'two', '12', '2.5'][p_size % 4 + 1] || ' ' || "
    "['week', 'hours', 'months', 'days', 'years'][p_partkey % 5 + 1] AS said, [1.0, 2.0, 12.0, 2.5][p_size % 4 + 1]::DOUBLE AS x, "
    "['weeks', 'hours', 'months', 'days', NULL][p_partkey % 5 + 1] AS unit, "
    "[7.0, 1.0 / 24, 30.0, 1.0, NULL][p_partkey % 5 + 1]::DOUBLE AS per FROM part"
)

SQL = {
    "fix_numbers": _row(_NUMBER_TEXT), "fix_sentinels": _row(f"CASE WHEN NOT {missing('amount')} THEN amount END"),
    "fix_dates_dmy": _row(_parsed("DMY")), "fix_dates_mdy": _row(_parsed("MDY")),
    "fix_epoch": _row("CASE WHEN stay LIKE '1900-%' THEN CAST(date_diff('day', DATE '1899-12-30', CAST(stay AS DATE)) AS VARCHAR) ELSE stay END"),
    "fix_units": _row("CASE WHEN course_days LIKE '% Days' THEN replace(course_days, ' Days', '') ELSE course_days END"),
    "fix_censored_boundary": _row(f"CASE WHEN regexp_matches({trim('amount')}, {_LIMIT}) THEN regexp_extract({trim('amount')}, {_LIMIT}, 2) ELSE amount END"),
    "fix_censored_missing": _row(f"CASE WHEN NOT regexp_matches({trim('amount')}, {_LIMIT}) THEN amount END"),
    "fix_variants": _row("CASE priority WHEN '1-urgent' THEN '1-URGENT' WHEN '2-high' THEN '2-HIGH' WHEN '2-HIGH  ' THEN '2-HIGH' "
                         "WHEN '5-LOW  ' THEN '5-LOW' ELSE priority END"),
    "apply_cell_fixes": with_tables(
        f", a AS (SELECT row_id, visit_date, CASE WHEN NOT {missing('amount')} THEN amount END AS v1 FROM messy_orders), "
        f"b AS (SELECT row_id, visit_date, {_STRIPPED} AS amount FROM a), c AS (SELECT row_id, visit_date, {_NUMBER_TEXT} AS amount FROM b) "
        f"SELECT row_id, CASE WHEN amount = '<0.5' THEN '0.5' ELSE amount END AS amount, {_parsed('DMY')} AS visit_date FROM c", ORDERS),
    "clean_scalars": with_tables(
        f"SELECT row_id, {fold('priority')} AS folded, regexp_replace(lower(priority), '[^a-z0-9]', '', 'g') AS name_key, "
        f"{num('amount')} AS number, {missing('amount')} AS missing, "
        f"greatest(1, len({_items('tags')})) AS items, "
        "coalesce(floor(CAST(row_id % 7 AS DOUBLE) / nullif(row_id % 9, 0) * 1000 + 0.5) / 10, 0.0) AS share, "
        f"{r2('(row_id % 1000 - 500) / 8.0::DOUBLE')} AS half_up FROM messy_orders", ORDERS),
    "date_ranks": with_tables(
        "SELECT row_id, CAST(date_diff('day', DATE '1970-01-01', CAST(try_strptime(visit_date, '%Y-%m-%d') AS DATE)) AS DOUBLE) AS day, "
        "coalesce(TRY_CAST(stay AS DOUBLE), date_diff('day', DATE '1970-01-01', CAST(try_strptime(stay, '%Y-%m-%d') AS DATE)) * 86400000000.0) AS stay "
        "FROM messy_orders", ORDERS),
    "period_labels": with_tables(
        f", p AS (SELECT row_id, nullif(regexp_extract(visit_date, '^(\\d{{4}})-(\\d{{2}})', 1), '') AS year, "
        f"nullif(regexp_extract(visit_date, '^(\\d{{4}})-(\\d{{2}})', 2), '') AS mo FROM messy_orders) "
        f"SELECT row_id, year || '-' || mo AS month, {_QUARTER} AS quarter, "
        "year || '-' || mo || '-01' AS time_order FROM p", ORDERS),
    "quantity_to_days": f"SELECT p_partkey, said, CASE WHEN unit IS NOT NULL THEN x END AS number, unit, {r2('x * per')} AS days, "
    f"unit = 'months' AS approximate, {r2('x * per * 24')} AS hours, CAST(NULL AS DOUBLE) AS unknown FROM ({_SAID})",
    "report_formats": f"SELECT p_partkey, {plain('p_retailprice')} || ' (SD ' || CAST(p_size AS VARCHAR) || ')' AS mean_sd, "
    "CAST(p_size AS VARCHAR) || ' (IQR not available)' AS median_iqr, "
    f"CAST(p_size AS VARCHAR) || ' (' || {plain('p_size * 2.0::DOUBLE')} || '%)' AS n_percent, "
    "format('{:,}', p_partkey) || ' (' || CAST(CAST(floor(p_partkey / 2000.0::DOUBLE * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%)' AS bar, "
    "CASE WHEN p_size / 20000.0 < 0.001 THEN '< 0.001' ELSE CAST(CAST(floor(p_size / 20.0::DOUBLE + 0.5) / 1000 AS DOUBLE) AS VARCHAR) END AS p_text, "
    "CAST(p_size AS VARCHAR) || ' days' AS stay FROM part",
    "word_forms": "SELECT DISTINCT w AS word, CASE w WHEN 'diagnoses' THEN 'diagnose' WHEN 'treated' THEN 'treat' WHEN 'boxes' THEN 'box' "
    "WHEN 'categories' THEN 'category' ELSE w END AS form, CASE w WHEN 'paediatric' THEN 'pediatric' WHEN 'travelled' THEN 'traveled' "
    "ELSE replace(w, 'll', 'l') END AS spelling FROM (SELECT unnest(string_split(p_name || "
    "' diagnoses treated boxes categories glass paediatric travelled', ' ')) AS w FROM part)",
    "short_forms": "SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'escherichia coli' WHEN 1 THEN f1 WHEN 2 THEN f2 END AS long_form FROM "
    "(SELECT s_suppkey, unnest(CASE s_suppkey % 4 WHEN 1 THEN ['methicillin resistant staphylococcus aureus', 'staphylococcus aureus'] ELSE ['x'] END) AS f1, "
    "CAST(NULL AS VARCHAR) AS f2 FROM supplier WHERE s_suppkey % 4 <> 2 UNION ALL SELECT s_suppkey, NULL, "
    "unnest(['clostridioides difficile', 'clostridium difficile']) FROM supplier WHERE s_suppkey % 4 = 2)",
    "masked_shapes": with_tables(
        "SELECT regexp_replace(regexp_replace(regexp_replace(priority, '[a-z]', 'a', 'g'), '[A-Z]', 'A', 'g'), '[0-9]', '9', 'g') AS shape, "
        "count(*) AS n, true AS kept FROM messy_orders WHERE priority IS NOT NULL GROUP BY 1", ORDERS),
    "keep_one_first": _survivors(f"{_DAY} ASC NULLS LAST"), "keep_one_last": _survivors(f"{_DAY} DESC NULLS LAST"),
    "keep_one_complete": _survivors(f"({_FILLED}) DESC"), "keep_one_firstrow": _survivors("row_id"),
    "keep_one_lastrow": _survivors("row_id DESC"), "keep_one_removed": _survivors(f"{_DAY} DESC NULLS LAST", keep=False),
    "keep_one_repeated_order": with_tables(
        f"SELECT k AS kept, n AS rows, n - k AS removed FROM (SELECT count_if({blank('patient_id')}) + count(DISTINCT lower({trim('patient_id')})) "
        f"FILTER (WHERE NOT {blank('patient_id')}) AS k, count(*) AS n FROM messy_orders)", ORDERS),
    "dedupe_rows": _visit_sql("", True), "dedupe_rows_removed": _visit_sql("", False),
    "dedupe_encounters": _visit_sql(_APART, True), "dedupe_encounters_removed": _visit_sql(_APART, False),
    "split_rows": with_tables(
        f"SELECT row_id, unnest(CASE WHEN len({_items('tags')}) = 0 THEN [NULL] ELSE {_items('tags')} END) AS tags FROM messy_orders", ORDERS),
    "paired_explode": with_tables(
        f", p AS ({_PAIRS}) SELECT row_id, tags, doses FROM p WHERE {_SHORT} UNION ALL "
        f"SELECT row_id, unnest(xs), unnest(ys) FROM p WHERE NOT {_SHORT} AND len(xs) = len(ys)", ORDERS),
    "paired_mismatched": with_tables(
        f", p AS ({_PAIRS}) SELECT row_id, tags, doses FROM p WHERE NOT {_SHORT} AND len(xs) <> len(ys)", ORDERS),
    "long_to_wide": "SELECT user_id, " + ", ".join(
        f"arg_max(value, event_id) FILTER (WHERE event_type = '{e}') AS {e}" for e in ("click", "error", "purchase", "signup", "view")
    ) + " FROM events GROUP BY 1",
    "long_to_wide_collisions": "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events)) AS collisions FROM events",
    "wide_to_long": with_tables(" UNION ALL ".join(
        f"SELECT row_id, '{c}' AS measure, {c} AS value FROM messy_orders WHERE NOT {blank(c)}" for c in ("priority", "amount", "tags")
    ), ORDERS),
}
