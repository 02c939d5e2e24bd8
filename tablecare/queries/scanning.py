"""The quality scan, profiles, types, fixes with their log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import is_number_text
from ..operators import fixes, profile, quality
from ..operators.fixes import Fix
from ..sources.tables import describe_columns, surviving_vocabulary
from ..sources.text import blank_row_count, drop_blank_rows, normalise
from .base import blank, derived, fold, missing, num, table, trim, with_tables
from .joining import _vocabulary

ORDERS, CUSTOMERS = "messy_orders", "messy_customer"
FIXES = [
    Fix("split_rows", "tags"), Fix("blank_markers", "amount"), Fix("number_text", "amount"),
    Fix("parse_date", "visit_date", {"order": "DMY"}), Fix("strip_unit", "course_days"),
    Fix("keep_one", "patient_id", {"policy": "last::visit_date"}), Fix("dedupe_rows"),
]
VISIT_FIXES = [Fix("dedupe_encounters", "visit_id"), Fix("dedupe_rows")]


def scan_orders(spark, folder):
    return quality.scan(
        derived(spark, folder, ORDERS), "orders", "row_id", today="2000-06-30", entity="patient_id",
        date_columns=["visit_date"],
    )


def scan_many_valued(spark, folder):
    """The same scan with every column taken for one of many values."""
    return quality.scan(
        derived(spark, folder, ORDERS), "orders", "row_id", today="2000-06-30", entity="patient_id", date_columns=["visit_date"], category=60,
    )


def copied_row_samples(spark, folder):
    """Examples of copied rows and repeated ids of an export with copies."""
    df = _encounters(spark, folder)
    found = quality.row_samples(df, [c for c in df.columns if c != "row_id"], "row_id")
    return found.select(F.col("__column").alias("column"), F.col("__type").alias("type"), F.array_join("samples", "|").alias("samples"))


def scan_customers(spark, folder):
    return quality.scan(derived(spark, folder, CUSTOMERS), "customers", "row_id", vocab=_vocabulary(spark, folder))


def _encounters(spark, folder):
    """Copied orders as an encounter export: repeated ids, some exact copies."""
    return derived(spark, folder, "copied_visits").withColumnRenamed("visit_id", "Encounter ID")


def scan_encounters(spark, folder):
    return quality.scan(_encounters(spark, folder), "encounters", "row_id")


def scan_all_tables(spark, folder):
    """Typed driver tables scanned together; dates, negatives and ids by schema."""
    tables = {
        "orders": table(spark, folder, "orders").withColumn("row_id", F.col("o_orderkey")),
        "events": table(spark, folder, "events").withColumn("row_id", F.col("event_id")),
    }
    return quality.scan_all(tables, "row_id", today="2001-06-30")


def scan_explained(spark, folder):
    found = quality.explained(scan_orders(spark, folder), derived(spark, folder, ORDERS), "row_id", today="2000-06-30")
    chosen = found.filter("type IN ('textNumbers', 'epochDates', 'censored', 'duplicateRows', 'duplicatePatientIds')")
    return chosen.select("column", "type", "count", "fixable", F.array_join("samples", "|").alias("samples"))


_LIMITS = (
    "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey % 3 = 0 THEN 'take 5 mg' WHEN o_orderkey % 3 = 1 THEN 'take 2 ml' ELSE 'as told' END AS note, "
    "CAST(o_orderkey % 140 AS STRING) AS age, CAST(o_orderkey % 50 - 2 AS STRING) AS dose, o_orderdate AS start_date, "
    "CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate - INTERVAL 3 DAY ELSE o_orderdate + INTERVAL 2 DAY END AS end_date FROM {0}"
)


def scan_limits(spark, folder):
    """Mixed units, impossible numbers and stays that end before they start."""
    df = spark.sql(_LIMITS.format("{orders}"), orders=table(spark, folder, "orders"))
    return quality.scan(df, "stays", "row_id").filter("type IN ('mixedUnits', 'impossible')")


def differing_ids(spark, folder):
    df = _encounters(spark, folder)
    return quality.differing_rows(df, "Encounter ID", ["Encounter ID", "customer", "priority", "note"], "row_id")


def scan_samples(spark, folder):
    return quality.samples(derived(spark, folder, ORDERS), ["amount", "stay"], lambda v: ~is_number_text(v), "row_id")


def grain_check(spark, folder):
    return quality.grain_finding(table(spark, folder, "orders"), "orders", "o_custkey")


def variant_map(spark, folder):
    df = derived(spark, folder, ORDERS)
    columns = ["priority", "second_priority", "status", "tags"]
    values = profile.value_frequencies(df, columns, first=F.col("row_id"))
    facts = quality.column_facts(df, values, columns, "9999-12-31")
    return quality.variant_map(values, quality.few_valued(facts))


def type_inference(spark, folder):
    return profile.infer_types(derived(spark, folder, ORDERS))


def type_inference_typed(spark, folder):
    return profile.infer_types(table(spark, folder, "lineitem"))


def profile_orders(spark, folder):
    return profile.profile(derived(spark, folder, ORDERS), "row_id")


def column_roles(spark, folder):
    df = derived(spark, folder, ORDERS)
    columns = [c for c in df.columns if c != "row_id"]
    return profile.role_order(profile.column_roles(profile.profile(df, "row_id"), columns), "grouping")


def described_columns(spark, folder):
    return describe_columns(derived(spark, folder, ORDERS), "row_id").select(
        "column", "type", F.array_join("samples", "|").alias("samples")
    )


def vocabulary_kept(spark, folder):
    changed = derived(spark, folder, CUSTOMERS).drop("nation")
    return surviving_vocabulary(_vocabulary(spark, folder), changed.columns)


def normalised_rows(spark, folder):
    df = derived(spark, folder, ORDERS).select("row_id", "patient_id", "amount", "tags")
    return drop_blank_rows(normalise(df, keep=("row_id",)), keep=("row_id",))


def blank_rows(spark, folder):
    df = derived(spark, folder, ORDERS).select(
        "row_id", F.when(F.col("row_id") % 13 == 0, F.col("patient_id")).alias("a"),
        F.when(F.col("row_id") % 10 == 0, F.col("tags")).alias("b"),
    )
    return blank_row_count(normalise(df, keep=("row_id",)), keep=("row_id",))


def _fixed(spark, folder):
    return fixes.apply_fixes(derived(spark, folder, ORDERS), FIXES, "row_id")


def apply_fixes_rows(spark, folder):
    return _fixed(spark, folder).rows.select("row_id", "patient_id", "amount", "visit_date", "tags", "course_days")


def apply_fixes_removed(spark, folder):
    return _fixed(spark, folder).removed.select("row_id", "removed_by")


def apply_fixes_log(spark, folder):
    return _fixed(spark, folder).log


def apply_fixes_copies(spark, folder):
    return fixes.apply_fixes(_encounters(spark, folder).withColumnRenamed("Encounter ID", "visit_id"), VISIT_FIXES, "row_id").log


def selected_findings(spark, folder):
    return fixes.select_findings(scan_orders(spark, folder), "missing", "Course Days")


QUERIES = {
    "scan_findings": scan_orders, "scan_customers": scan_customers, "scan_encounters": scan_encounters,
    "scan_many_valued": scan_many_valued, "copied_row_samples": copied_row_samples, "scan_all_tables": scan_all_tables, "scan_explained": scan_explained, "scan_limits": scan_limits, "differing_ids": differing_ids, "scan_samples": scan_samples,
    "grain_check": grain_check, "variant_map": variant_map, "type_inference": type_inference,
    "type_inference_typed": type_inference_typed, "profile": profile_orders, "column_roles": column_roles,
    "described_columns": described_columns, "vocabulary_kept": vocabulary_kept, "normalised_rows": normalised_rows,
    "blank_rows": blank_rows, "apply_fixes_rows": apply_fixes_rows, "apply_fixes_removed": apply_fixes_removed,
    "apply_fixes_log": apply_fixes_log, "apply_fixes_copies": apply_fixes_copies, "selected_findings": selected_findings,
}

# --- the same in SQL ------------------------------------------------------------------------


def _finding(table_name, column, kind, count, detail=None, fix=None, param=None):
    text = lambda v: "CAST(NULL AS VARCHAR)" if v is None else v if v.startswith(("'", "(")) else f"'{v}'"
    return (
        f"SELECT '{table_name}' AS \"table\", {text(column)} AS \"column\", '{kind}' AS type, CAST({count} AS BIGINT) AS count, "
        f"{text(detail)} AS detail, {text(fix)} AS fix, {text(param)} AS param"
    )


def _m(count):
    return f"(SELECT {count} FROM messy_orders)"


_DMY = (
    "count_if(visit_date LIKE '%/%' AND try_strptime(split_part(visit_date, '/', 3) || '-' || lpad(split_part(visit_date, '/', 2), 2, '0') "
    "|| '-' || lpad(split_part(visit_date, '/', 1), 2, '0'), '%Y-%m-%d') IS NOT NULL)"
)
_IS_NUMBER = "regexp_matches(regexp_replace({c}, '[$,\\s]', '', 'g'), '^-?\\d+(\\.\\d+)?$')"
_AMOUNT_NUMBER = _IS_NUMBER.format(c="amount")


def _variant_count(column, source):
    return (
        f"(SELECT coalesce(sum(v - 1), 0) FROM (SELECT count(DISTINCT {column}) AS v FROM {source} WHERE NOT {blank(column)} GROUP BY {fold(column)}))"
    )


_FOUND = [
    _finding("orders", "patient_id", "duplicatePatientIds",
             "(SELECT count(*) FROM (SELECT id, count(*) AS n FROM (SELECT DISTINCT * EXCLUDE (row_id), " + trim("patient_id") +
             f" AS id FROM messy_orders WHERE NOT {blank('patient_id')}) GROUP BY 1 HAVING count(*) > 1))",
             "first::visit_date | last::visit_date | complete", "keep_one", "policy?"),
    _finding("orders", None, "duplicateRows", "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM messy_orders)) FROM messy_orders)",
             None, "dedupe_rows"),
    *[_finding("orders", c, "missing", _m(f"count_if({blank(c)})"), "empty") for c in ("patient_id", "second_priority")],
    _finding("orders", "tags", "missing", _m(f"count_if({blank('tags')})"), "empty"),
    *[_finding("orders", c, "missing", _m(f"count_if({missing(c)})"), "markers", "blank_markers")
      for c in ("priority", "amount", "visit_date", "course_days")],
    _finding("orders", "amount", "textNumbers", _m(f"count_if({_AMOUNT_NUMBER})"), None, "number_text"),
    _finding("orders", "stay", "textNumbers", _m("count_if(regexp_matches(stay, '^\\d+$'))"), None, "number_text"),
    _finding("orders", "doses", "textNumbers", _m(f"count_if({_IS_NUMBER.format(c='doses')})"), None, "number_text"),
    _finding("orders", "visit_date", "textDates", _m(_DMY), "0 unreadable", "parse_date", "DMY"),
    _finding("orders", "stay", "epochDates", _m("count_if(stay LIKE '1900-%')"), None, "epoch_serial"),
    _finding("orders", "course_days", "unitSuffixNumbers", _m("count_if(course_days LIKE '% Days')"), "days", "strip_unit"),
    _finding("orders", "amount", "unitSuffixNumbers", _m("count_if(amount LIKE '% mg')"), "mg", "strip_unit"),
    *[_finding("orders", c, "categoryVariants", _variant_count(c, "messy_orders"), None, "merge_spellings", "map") for c in ("patient_id", "priority")],
    _finding("orders", "amount", "censored", _m("count_if(amount = '<0.5')"), None, "censored", "policy?"),
    *[_finding("orders", c, "multiValue", _m(f"count_if(regexp_matches({c}, '[^\\s,;]\\s*[,;].*[^\\s,;]'))"), None, "split_rows")
      for c in ("tags", "doses", "amount")],
    _finding("orders", "patient_id", "repeating_entity", _m(f"count(DISTINCT {fold('patient_id')}) FILTER (WHERE NOT {blank('patient_id')})"),
             f"(SELECT count(*) FILTER (WHERE NOT {blank('patient_id')}) || ' rows, ' || count(DISTINCT {fold('patient_id')}) "
             f"FILTER (WHERE NOT {blank('patient_id')}) || ' entities' FROM messy_orders)"),
]


def _c(count):
    return f"(SELECT {count} FROM messy_customer)"


_CUSTOMER_FOUND = [
    _finding("customers", None, "duplicateRows", "(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * EXCLUDE (row_id) FROM messy_customer)) FROM messy_customer)",
             None, "dedupe_rows"),
    _finding("customers", "balance", "duplicateIds", "(SELECT count(*) FROM (SELECT balance FROM messy_customer GROUP BY 1 HAVING count(*) > 1))"),
    _finding("customers", "segment", "missing", _c("count_if(segment IS NULL)"), "empty"),
    _finding("customers", "doctor", "missing", _c("count_if(doctor IS NULL)"), "empty"),
    _finding("customers", "doctor", "categoryVariants", _variant_count("doctor", "messy_customer"), None, "merge_spellings", "map"),
    _finding("customers", "segment", "categoryVariants", _variant_count("segment", "messy_customer"), None, "merge_spellings", "map"),
    _finding("customers", "segment", "notInPicklist", _c("count_if(segment LIKE '%X')")),
    _finding("customers", "nation", "notInPicklist", _c("count_if(nation = 'Nowhere')")),
]
_VISIT_ROWS = "(SELECT CAST(visit_id AS VARCHAR) AS visit_id, customer, priority, note FROM copied_visits)"
_IDS = f"(SELECT visit_id, count(*) AS n, count(DISTINCT (customer, priority, note)) AS d FROM {_VISIT_ROWS} WHERE visit_id IS NOT NULL GROUP BY 1)"
_ENCOUNTER_FOUND = [
    _finding("encounters", None, "duplicateRows", f"(SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {_VISIT_ROWS})) FROM copied_visits)", None, "dedupe_rows"),
    _finding("encounters", "Encounter ID", "duplicateEncounterIds", f"(SELECT count(*) FROM {_IDS} WHERE n > 1)",
             f"(SELECT CAST(sum(n - d) AS BIGINT) || ' copies, ' || count_if(d > 1) || ' differing' FROM {_IDS})", "dedupe_encounters"),
    _finding("encounters", "Encounter ID", "missing", "(SELECT count_if(visit_id IS NULL) FROM copied_visits)", "empty"),
    _finding("encounters", "note", "textNumbers", "(SELECT count_if(note <> 'same') FROM copied_visits)", None, "number_text"),
]
_ID_LIKE = [
    *[("orders", c, c) for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")],
    ("orders", "o_orderdate", "o_orderdate"), ("events", "ts", "strftime(ts, '%Y-%m-%d %H:%M')"),
    *[("events", c, c) for c in ("event_id", "user_id", "event_type", "value", "props")],
]
_ALL_FOUND = [
    _finding("orders", "o_orderdate", "impossible", "(SELECT count_if(o_orderdate >= TIMESTAMP '2001-07-01') FROM orders)", "in the future"),
    _finding("events", "ts", "impossible", "(SELECT count(*) FROM events)", "in the future"),
    *[_finding(t, c, "duplicateIds", f"(SELECT count_if(k > 1) FROM (SELECT {v} AS v, count(*) AS k FROM {t} GROUP BY 1) "
               f"HAVING count(*) >= 0.9 * sum(k))") for t, c, v in _ID_LIKE],
]


def _likely_grain(table_name, source, columns):
    """The first nearly unique column with a repeat, in the order of the columns."""
    facts = " UNION ALL ".join(
        f"SELECT {i} AS i, '{c}' AS c, count({v}) AS f, count(DISTINCT {v}) AS d FROM {source}" for i, (c, v) in enumerate(columns)
    )
    return (
        f"SELECT '{table_name}' AS \"table\", c AS \"column\", 'repeating_entity' AS type, d AS count, f || ' rows, ' || d || ' entities' AS detail, "
        f"CAST(NULL AS VARCHAR) AS fix, CAST(NULL AS VARCHAR) AS param FROM (SELECT * FROM ({facts}) WHERE f >= 4 AND d >= 0.9 * f AND d < f ORDER BY i LIMIT 1)"
    )


_CUSTOMER_FOUND.append(_likely_grain("customers", "messy_customer", [("balance", "balance")]))
_ALL_FOUND += [_likely_grain(t, t, [(c, v) for u, c, v in _ID_LIKE if u == t]) for t in ("orders", "events")]


def _explained(column, kind, test):
    seen = f"SELECT {column} AS v, min(row_id) AS f FROM messy_orders WHERE {test} GROUP BY 1 ORDER BY f LIMIT 5"
    return (
        f"SELECT '{column}' AS \"column\", '{kind}' AS type, (SELECT count(*) FROM messy_orders WHERE {test}) AS count, true AS fixable, "
        f"(SELECT string_agg(v, '|' ORDER BY f) FROM ({seen})) AS samples"
    )


_CELLS_TOLD = "patient_id, priority, second_priority, status, amount, visit_date, tags, doses, stay, course_days"
_EXPLAINED = [
    _explained("amount", "textNumbers", _AMOUNT_NUMBER), _explained("stay", "textNumbers", "regexp_matches(stay, '^\\d+$')"),
    _explained("doses", "textNumbers", _IS_NUMBER.format(c="doses")), _explained("stay", "epochDates", "stay LIKE '1900-%'"),
    _explained("amount", "censored", "amount = '<0.5'"),
    "SELECT CAST(NULL AS VARCHAR) AS \"column\", 'duplicateRows' AS type, (SELECT count(*) - (SELECT count(*) FROM "
    "(SELECT DISTINCT * EXCLUDE (row_id) FROM messy_orders)) FROM messy_orders) AS count, true AS fixable, (SELECT string_agg(s, '|' ORDER BY row_id) "
    f"FROM (SELECT row_id, array_to_string(list_filter([{_CELLS_TOLD}], lambda x: x IS NOT NULL)[1:3], ' · ') AS s FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY {_CELLS_TOLD} ORDER BY row_id) AS rn FROM messy_orders) WHERE rn = 2 ORDER BY row_id LIMIT 3)) AS samples",
    "SELECT 'patient_id' AS \"column\", 'duplicatePatientIds' AS type, count(*) AS count, true AS fixable, "
    "string_agg(id || ' (' || n || '×)', '|' ORDER BY f) FILTER (WHERE place <= 5) AS samples FROM (SELECT *, row_number() OVER (ORDER BY f) AS place FROM "
    "(SELECT " + trim("patient_id") + " AS id, count(DISTINCT rest) AS n, min(row_id) AS f FROM (SELECT row_id, patient_id, "
    f"row({_CELLS_TOLD}) AS rest FROM messy_orders "
    f"WHERE NOT {blank('patient_id')}) GROUP BY 1 HAVING count(DISTINCT rest) > 1))",
]
_STAYS = "(" + _LIMITS.format("orders").replace("AS STRING", "AS VARCHAR") + ")"
_LIMITS_FOUND = [
    _finding("stays", "note", "mixedUnits", f"(SELECT count_if(note LIKE 'take%') FROM {_STAYS})", "mg, ml"),
    _finding("stays", "age", "impossible", f"(SELECT count_if(CAST(age AS INT) > 120) FROM {_STAYS})", "age over 120"),
    _finding("stays", "dose", "impossible", f"(SELECT count_if(CAST(dose AS INT) < 0) FROM {_STAYS})", "negative"),
    _finding("stays", "end_date", "impossible", f"(SELECT count_if(end_date < start_date) FROM {_STAYS})", "before start_date"),
]


def _class_of(c):
    """The class of a text column of messy_orders, from its cells (row_id is typed)."""
    plain, marked = f"regexp_matches({c}, '^-?\\d+(\\.\\d+)?$')", f"(NOT {blank(c)} AND {missing(c)})"
    cells = (
        f"SELECT count_if(NOT {blank(c)}) AS filled, count_if({plain}) AS numbers, count_if(regexp_matches({c}, '^\\d{{{{4}}}}-\\d{{{{2}}}}-\\d{{{{2}}}}')) AS iso, "
        f"count_if({marked}) AS markers, count(TRY_CAST({c} AS DOUBLE)) AS castable FROM messy_orders"
    ).replace("{{", "{").replace("}}", "}")
    kind = (
        "CASE WHEN filled = 0 THEN 'empty' WHEN numbers = filled THEN 'number' WHEN iso > 0 AND iso + markers = filled THEN 'date' "
        "WHEN numbers > 0 THEN 'mixed (text + numbers)' ELSE 'text' END"
    )
    return (
        f"SELECT '{c}' AS \"column\", {kind} AS type, {kind} IN ('number', 'mixed (text + numbers)') OR (filled > 0 AND castable = filled) AS is_numeric FROM ({cells})"
    )


def _union(parts):
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE count > 0"


_LAST = (
    "PARTITION BY CASE WHEN {b} THEN 'row ' || CAST(row_id AS VARCHAR) ELSE lower({t}) END "
    "ORDER BY try_strptime(visit_date, '%Y-%m-%d') DESC NULLS LAST, row_id"
).format(b=blank("patient_id"), t=trim("patient_id"))
_DATES = (
    "coalesce(strftime(try_strptime(split_part(visit_date, '/', 3) || '-' || lpad(split_part(visit_date, '/', 2), 2, '0') || '-' || "
    "lpad(split_part(visit_date, '/', 1), 2, '0'), '%Y-%m-%d'), '%Y-%m-%d'), visit_date)"
)
_NUM = f"CASE WHEN {_AMOUNT_NUMBER} THEN regexp_replace(amount, '[$,\\s]', '', 'g') ELSE amount END"
_CELLS = (
    f"cells AS (SELECT * REPLACE (CASE WHEN amount <> 'N/A' THEN {_NUM} END AS amount, {_DATES} AS visit_date, "
    "replace(course_days, ' Days', '') AS course_days) FROM messy_orders), "
    "single AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, priority, second_priority, status, amount, "
    "visit_date, tags, doses, stay, course_days ORDER BY row_id) AS rn FROM cells) WHERE rn = 1), "
    f"kept AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER ({_LAST}) AS rn FROM single) WHERE rn = 1), "
    "split AS (SELECT row_id, patient_id, amount, visit_date, course_days, unnest(CASE WHEN len(items) = 0 THEN [NULL] ELSE items END) AS tags FROM "
    "(SELECT *, list_filter(list_transform(regexp_split_to_array(coalesce(tags, ''), '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS items FROM kept))"
)


def _log(step, action, changed, before, after):
    return (
        f"SELECT {step} AS step, '{action}' AS action, CAST({changed} AS BIGINT) AS cells_changed, "
        f"(SELECT count(*) FROM {before}) AS rows_before, (SELECT count(*) FROM {after}) AS rows_after"
    )


_TEXT_COLUMNS = ["patient_id", "priority", "second_priority", "status", "amount", "visit_date", "tags", "doses", "stay", "course_days"]
_TYPES = {
    "row_id": "number", "patient_id": "text", "priority": "text", "second_priority": "text", "status": "text",
    "amount": "mixed (text + numbers)", "visit_date": "text", "tags": "text", "doses": "mixed (text + numbers)",
    "stay": "mixed (text + numbers)", "course_days": "text",
}


def _profile_row(c):
    """Distinct and filled counts by SQL; the class and a text column's top three beside them."""
    top = (
        f"(SELECT string_agg(v || ' (' || n || ')', ', ' ORDER BY n DESC, f) FROM (SELECT {c} AS v, count(*) AS n, min(row_id) AS f "
        f"FROM messy_orders WHERE NOT {blank(c)} GROUP BY 1 ORDER BY n DESC, f LIMIT 3))"
    )
    return (
        f"SELECT '{c}' AS \"column\", '{_TYPES[c]}' AS type, CAST(floor(count_if(NOT {blank(c)}) * 100.0::DOUBLE / count(*) + 0.5) AS INTEGER) AS filled_pct, "
        f"count(DISTINCT lower({trim(c)})) FILTER (WHERE NOT {blank(c)}) AS distinct, {top} AS summary, false AS is_empty, false AS is_constant, "
        f"count(*) AS rows, count_if(NOT {blank(c)}) AS filled FROM messy_orders"
    )


def _sample_row(c):
    return (
        f"SELECT '{c}' AS \"column\", '{_TYPES[c]}' AS type, (SELECT string_agg(v, '|' ORDER BY f) FROM (SELECT {c} AS v, min(row_id) AS f "
        f"FROM messy_orders WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY f LIMIT 4)) AS samples"
    )


_COPIED_ROW = "concat_ws(' · ', CAST(visit_id AS VARCHAR), CAST(customer AS VARCHAR), CASE WHEN visit_id IS NULL THEN priority || ' · ' || note ELSE priority END)"

SQL = {
    "scan_many_valued": with_tables(_union(_FOUND), ORDERS),
    "copied_row_samples": with_tables(
        f" SELECT CAST(NULL AS VARCHAR) AS \"column\", 'duplicateRows' AS type, string_agg(s, '|' ORDER BY row_id) AS samples FROM (SELECT row_id, {_COPIED_ROW} AS s FROM "
        "(SELECT *, row_number() OVER (PARTITION BY visit_id, customer, priority, note ORDER BY row_id) AS rn FROM copied_visits) WHERE rn = 2 ORDER BY row_id LIMIT 3) "
        "UNION ALL SELECT 'Encounter ID', 'duplicateEncounterIds', string_agg(visit_id || ' (' || n || '×)', '|' ORDER BY f) FROM "
        "(SELECT visit_id, count(*) AS n, min(row_id) AS f FROM copied_visits WHERE visit_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1 ORDER BY f LIMIT 5)",
        "copied_visits"),
    "scan_findings": with_tables(_union(_FOUND), ORDERS), "scan_customers": with_tables(_union(_CUSTOMER_FOUND), CUSTOMERS),
    "scan_encounters": with_tables(_union(_ENCOUNTER_FOUND), "copied_visits"), "scan_all_tables": _union(_ALL_FOUND),
    "differing_ids": with_tables(
        f", ids AS (SELECT visit_id, min(row_id) AS f FROM copied_visits WHERE visit_id IS NOT NULL GROUP BY 1 "
        "HAVING count(DISTINCT (customer, priority, note)) > 1 ORDER BY f LIMIT 5) "
        "SELECT row_id, visit_id AS \"Encounter ID\", customer, priority, note FROM (SELECT *, row_number() OVER (PARTITION BY visit_id ORDER BY row_id) AS rn "
        "FROM copied_visits WHERE visit_id IN (SELECT visit_id FROM ids)) WHERE rn <= 4", "copied_visits"),
    "scan_samples": with_tables(" UNION ALL ".join(
        f"SELECT * FROM (SELECT '{c}' AS \"column\", row_number() OVER (ORDER BY min(row_id)) AS place, {c} AS value, count(*) AS n FROM messy_orders "
        f"WHERE coalesce(NOT {_IS_NUMBER.format(c=c)}, true) GROUP BY {c}) WHERE place <= 5" for c in ("amount", "stay")), ORDERS),
    "grain_check": _finding("orders", "o_custkey", "repeating_entity", "(SELECT count(DISTINCT o_custkey) FROM orders)",
                            "(SELECT count(*) || ' rows, ' || count(DISTINCT o_custkey) || ' entities' FROM orders)"),
    "variant_map": with_tables(
        f"SELECT 'priority' AS \"column\", raw, first_value(raw) OVER (PARTITION BY k ORDER BY n DESC, f) AS canonical, n, spellings FROM "
        f"(SELECT *, count(*) OVER (PARTITION BY k) AS spellings FROM (SELECT priority AS raw, {fold('priority')} AS k, count(*) AS n, min(row_id) AS f "
        f"FROM messy_orders WHERE NOT {blank('priority')} GROUP BY 1, 2)) WHERE spellings > 1", ORDERS),
    "type_inference": with_tables(
        "SELECT 'row_id' AS \"column\", 'number' AS type, true AS is_numeric UNION ALL " + " UNION ALL ".join(_class_of(c) for c in _TEXT_COLUMNS), ORDERS),
    "scan_explained": with_tables(_union(_EXPLAINED), ORDERS), "scan_limits": _union(_LIMITS_FOUND),
    "type_inference_typed": "SELECT column_name AS \"column\", CASE WHEN column_name = 'l_shipdate' THEN 'date' WHEN column_name IN "
    "('l_returnflag', 'l_linestatus') THEN 'text' ELSE 'number' END AS type, column_name NOT IN ('l_shipdate', 'l_returnflag', 'l_linestatus') "
    "AS is_numeric FROM (DESCRIBE lineitem)",
    "profile": with_tables(
        "SELECT * REPLACE (CASE WHEN \"column\" = 'doses' THEN 'number (stored as text)' ELSE type END AS type, "
        "CASE WHEN \"column\" = 'doses' THEN (SELECT min(x) || ' – ' || max(x) FROM (SELECT CAST(regexp_replace(doses, '[,\\s]', '', 'g') AS BIGINT) AS x "
        "FROM messy_orders)) ELSE summary END AS summary) FROM (" + " UNION ALL ".join(_profile_row(c) for c in _TEXT_COLUMNS) + ")", ORDERS),
    "column_roles": with_tables(" UNION ALL ".join(
        f"SELECT 'doses' AS \"column\", 'number (stored as text)' AS badge, false AS suits_grouping, true AS suits_outcome, false AS suits_axis, {i} AS position"
        if c == "doses" else f"SELECT '{c}' AS \"column\", 'text · ' || d || ' value' || CASE WHEN d = 1 THEN '' ELSE 's' END AS badge, d BETWEEN 2 AND 10 AS suits_grouping, "
        f"false AS suits_outcome, d <= 12 AS suits_axis, {i} AS position FROM (SELECT count(DISTINCT lower({trim(c)})) AS d FROM messy_orders WHERE NOT {blank(c)})"
        for i, c in enumerate(_TEXT_COLUMNS)), ORDERS),
    "described_columns": with_tables(" UNION ALL ".join(_sample_row(c) for c in _TEXT_COLUMNS), ORDERS),
    "vocabulary_kept": "SELECT DISTINCT 'segment' AS \"column\", c_mktsegment AS term FROM customer",
    "normalised_rows": with_tables(
        f"SELECT * FROM (SELECT row_id, nullif({trim('patient_id')}, '') AS patient_id, CASE WHEN {_AMOUNT_NUMBER} THEN "
        f"regexp_replace(amount, '[$,\\s]', '', 'g') ELSE {trim('amount')} END AS amount, nullif({trim('tags')}, '') AS tags FROM messy_orders) "
        "WHERE patient_id IS NOT NULL OR amount IS NOT NULL OR tags IS NOT NULL", ORDERS),
    "blank_rows": with_tables(
        f"SELECT count_if((row_id % 13 <> 0 OR {blank('patient_id')}) AND (row_id % 10 <> 0 OR {blank('tags')})) AS dropped FROM messy_orders", ORDERS),
    "apply_fixes_rows": with_tables(f", {_CELLS} SELECT row_id, patient_id, amount, visit_date, tags, course_days FROM split", ORDERS),
    "apply_fixes_removed": with_tables(
        f", {_CELLS} SELECT row_id, CASE WHEN row_id IN (SELECT row_id FROM single) THEN 'keep_one(patient_id)' ELSE 'dedupe_rows' END AS removed_by "
        "FROM cells WHERE row_id NOT IN (SELECT row_id FROM kept)", ORDERS),
    "apply_fixes_log": with_tables(f", {_CELLS} " + " UNION ALL ".join([
        _log(0, "blank_markers(amount)", _m("count_if(amount = 'N/A')"), "cells", "cells"),
        _log(1, "number_text(amount)", _m(f"count_if({_AMOUNT_NUMBER} AND regexp_matches(amount, '[$,\\s]'))"), "cells", "cells"),
        _log(2, "parse_date(visit_date)", _m(_DMY), "cells", "cells"),
        _log(3, "strip_unit(course_days)", _m("count_if(course_days LIKE '% Days')"), "cells", "cells"),
        _log(4, "dedupe_rows", "0", "cells", "single"), _log(5, "keep_one(patient_id)", "0", "single", "kept"),
        _log(6, "split_rows(tags)", "0", "kept", "split"),
    ]), ORDERS),
    "apply_fixes_copies": with_tables(" UNION ALL ".join([
        _log(0, "dedupe_rows", "0", "copied_visits", f"(SELECT DISTINCT * FROM {_VISIT_ROWS})"),
        _log(1, "dedupe_encounters(visit_id)", "0", f"(SELECT DISTINCT * FROM {_VISIT_ROWS})", f"(SELECT DISTINCT * FROM {_VISIT_ROWS})"),
    ]), "copied_visits"),
    "selected_findings": with_tables(
        _finding("orders", "course_days", "missing", _m(f"count_if({missing('course_days')})"), "markers", "blank_markers"), ORDERS),
}
