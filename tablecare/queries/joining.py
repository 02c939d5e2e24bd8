"""Anti join, lookup, as-of, vocabulary, definitions, codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from ..operators.conditions import definition_flags, keep_defined
from ..sources.rules import load_definitions, merge_definitions, merge_vocabulary, parse_definitions
from .base import blank, derived, fold, num, table, trim, with_tables


def anti_join(spark, folder):
    a = table(spark, folder, "customer").withColumn("key", F.concat(F.lit(" C"), "c_custkey"))
    b = table(spark, folder, "orders").withColumn(
        "key", F.when(F.col("o_custkey") % 3 != 0, F.concat(F.lit("c"), "o_custkey", F.lit(" ")))
    )
    return joins.anti_join(a, b, "key").select("c_custkey", "c_name")


def _lookup(spark, folder):
    brands = table(spark, folder, "part").selectExpr("upper(p_brand) AS brand", "p_type", "p_size", "p_partkey")
    asked = table(spark, folder, "part").selectExpr(
        "p_partkey AS id", "CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 7 = 1 THEN concat(p_brand, 'x') ELSE concat(' ', p_brand) END AS brand"
    )
    return joins.lookup_join(asked, brands, "brand", ["p_type", "p_size"], "p_partkey")


def lookup_join(spark, folder):
    return _lookup(spark, folder).rows


def lookup_unmatched(spark, folder):
    return _lookup(spark, folder).unmatched


def _as_of(spark, folder):
    events = table(spark, folder, "events")
    asked = events.filter("event_type IN ('purchase', 'error')").select("event_id", "user_id", "ts")
    priors = events.filter("event_type NOT IN ('purchase', 'error')").select("event_id", "user_id", "ts", "value")
    return joins.as_of_join(asked, priors, "user_id", "ts", ["value", "event_id"], "event_id")


def asof_join(spark, folder):
    return _as_of(spark, folder).rows.select("event_id", "user_id", "prior_value", "prior_event_id")


def asof_unmatched(spark, folder):
    return _as_of(spark, folder).unmatched.select("event_id", "user_id")


def _asof_days(spark, folder):
    """Orders against earlier orders of the same customer, by day text, with ties and unreadable days."""
    df = derived(spark, folder, "messy_orders")
    return joins.as_of_join(
        df.filter("row_id % 2 = 0").select("row_id", "patient_id", "visit_date"),
        df.filter("row_id % 2 = 1").select("row_id", "patient_id", "visit_date", "status"),
        "patient_id", "visit_date", ["row_id", "status"], "row_id",
    ).rows


def asof_join_text(spark, folder):
    return _asof_days(spark, folder).select("row_id", "prior_row_id", "prior_status")


def _vocabulary(spark, folder):
    """Market segments and nation names as the legal terms, some listed twice."""
    segments = table(spark, folder, "customer").selectExpr("'segment' AS column", "c_mktsegment AS term")
    nations = table(spark, folder, "nation").selectExpr("'nation' AS column", "concat('NATION ', n_nationkey) AS term")
    return merge_vocabulary(segments.unionByName(nations))


def vocab_violations(spark, folder):
    return joins.off_vocabulary(
        derived(spark, folder, "messy_customer").drop("row_id"), _vocabulary(spark, folder), ["segment", "nation", "doctor"]
    )


def vocabulary(spark, folder):
    return _vocabulary(spark, folder)


def _definitions(spark, folder):
    """A definitions table over the customers: 20 terms, each defined again and again, the last one winning."""
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS row_id", "concat('Term ', c_custkey % 20, CASE WHEN c_custkey >= 20 THEN 's' ELSE '' END) AS Term",
        "CASE WHEN c_custkey % 2 = 0 THEN 'Status' ELSE 'amount' END AS `Column it applies to`",
        "CASE WHEN c_custkey % 2 = 0 THEN 'F, o or x' ELSE concat('> ', c_custkey % 100 * 10, CASE WHEN c_custkey % 20 % 3 = 0 "
        "THEN ' when Status = P' ELSE '' END) END AS `Values that count`",
    )


def definitions_table(spark, folder):
    parsed = parse_definitions(_definitions(spark, folder), "row_id")
    return parsed.select(
        "key", "term", "column", "rule.kind", "rule.op", "rule.value", "rule.when_column", "rule.when_value",
        F.array_join("rule.values", "|").alias("listed"),
    )


def definitions_merged(spark, folder):
    parsed = parse_definitions(_definitions(spark, folder), "row_id")
    store = parse_definitions(table(spark, folder, "nation").selectExpr(
        "n_nationkey AS row_id", "concat('term ', n_nationkey % 3) AS Term", "'Status' AS `Column`", "'z; y' AS `Values that count`",
    ), "row_id")
    return merge_definitions(parsed, store).select("key", "rule.kind", F.array_join("rule.values", "|").alias("listed"))


def definitions_filter(spark, folder):
    df = derived(spark, folder, "messy_orders")
    defs = load_definitions(parse_definitions(_definitions(spark, folder), "row_id"), df.columns)
    flagged = definition_flags(df, defs)
    flags = sorted(c for c in flagged.columns if c.startswith("is_"))
    return flagged.agg(*[F.count_if(c).alias(c) for c in flags])


def definition_rows(spark, folder):
    df = derived(spark, folder, "messy_orders")
    defs = load_definitions(parse_definitions(_definitions(spark, folder), "row_id"), df.columns)
    return keep_defined(df, defs, "term 9s").select("row_id", "status", "amount")


def replace_codes(spark, folder):
    codes = table(spark, folder, "supplier").selectExpr("concat('Dr ', s_suppkey % 60) AS name", "concat('P', s_suppkey % 60) AS code").distinct()
    return joins.replace_by_codes(derived(spark, folder, "messy_customer"), "doctor", codes).select("row_id", "doctor")


QUERIES = {
    "anti_join": anti_join, "lookup_join": lookup_join, "lookup_unmatched": lookup_unmatched, "asof_join": asof_join,
    "asof_unmatched": asof_unmatched, "asof_join_text": asof_join_text, "vocabulary": vocabulary,
    "vocab_violations": vocab_violations, "definitions_table": definitions_table, "definitions_merged": definitions_merged,
    "definitions_filter": definitions_filter, "definition_rows": definition_rows, "replace_codes": replace_codes,
}

_LOOKUP = (
    "(SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN ' ' WHEN p_partkey % 7 = 1 THEN p_brand || 'x' ELSE ' ' || p_brand END AS brand FROM part) a LEFT JOIN "
    "(SELECT lower(p_brand) AS k, arg_min(p_type, p_partkey) AS p_type, arg_min(p_size, p_partkey) AS p_size FROM part "
    "GROUP BY 1) b ON lower(trim(a.brand)) = b.k"
)
_ASOF = (
    "(SELECT event_id, user_id, ts FROM events WHERE event_type IN ('purchase', 'error')) e ASOF LEFT JOIN "
    "(SELECT user_id, ts, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events "
    "WHERE event_type NOT IN ('purchase', 'error') GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts"
)
_DAY = "coalesce(epoch(try_strptime(visit_date, '%Y-%m-%d')), -1e18)"
_TERMS = (
    "SELECT DISTINCT 'segment' AS column, c_mktsegment AS term FROM customer UNION ALL "
    "SELECT 'nation', 'NATION ' || CAST(n_nationkey AS VARCHAR) FROM nation"
)


def _off(column):
    return (
        f"SELECT '{column}' AS column, {column} AS value, count(*) AS n FROM messy_customer WHERE NOT {blank(column)} AND "
        f"{fold(column)} NOT IN (SELECT lower(term) FROM terms WHERE \"column\" = '{column}') GROUP BY 2"
    )


_RULES = (
    "SELECT c_custkey AS k, 'term' || CAST(c_custkey % 20 AS VARCHAR) AS key, 'Term ' || CAST(c_custkey % 20 AS VARCHAR) || "
    "CASE WHEN c_custkey >= 20 THEN 's' ELSE '' END AS term FROM customer "
    "QUALIFY row_number() OVER (PARTITION BY c_custkey % 20 ORDER BY c_custkey DESC) = 1"
)
_EVEN = "k % 2 = 0"


def _defined(term):
    """Rows of messy orders one of the 20 terms holds for."""
    if term % 2 == 0:
        return "status IN ('F', 'O')"
    bound = f"(SELECT max(c_custkey) % 100 * 10 FROM customer WHERE c_custkey % 20 = {term})"
    return f"({num('amount')} > {bound}" + (" AND status = 'P')" if term % 3 == 0 else ")")


SQL = {
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey % 3 <> 0)",
    "lookup_join": f"SELECT a.id, a.brand, b.p_type, b.p_size FROM {_LOOKUP}",
    "lookup_unmatched": f"SELECT a.id, a.brand FROM {_LOOKUP} WHERE b.k IS NULL",
    "asof_join": f"SELECT e.event_id, e.user_id, p.value AS prior_value, p.event_id AS prior_event_id FROM {_ASOF}",
    "asof_unmatched": f"SELECT e.event_id, e.user_id FROM {_ASOF} WHERE p.user_id IS NULL",
    "asof_join_text": with_tables(
        f", m AS (SELECT row_id, {fold('patient_id')} AS k, {_DAY} AS t, status FROM messy_orders), "
        "p AS (SELECT k, t, max(row_id) AS prior_row_id, arg_max(status, row_id) AS prior_status FROM m "
        "WHERE row_id % 2 = 1 AND k IS NOT NULL GROUP BY 1, 2) "
        "SELECT e.row_id, p.prior_row_id, p.prior_status FROM (SELECT * FROM m WHERE row_id % 2 = 0) e "
        "ASOF LEFT JOIN p ON e.k = p.k AND e.t >= p.t", "messy_orders"),
    "vocabulary": _TERMS,
    "vocab_violations": with_tables(f", terms AS ({_TERMS}) {_off('segment')} UNION ALL {_off('nation')}", "messy_customer"),
    "definitions_table": "SELECT key, term, CASE WHEN " + _EVEN + " THEN 'Status' ELSE 'amount' END AS column, "
    "CASE WHEN " + _EVEN + " THEN 'values' ELSE 'threshold' END AS kind, CASE WHEN NOT " + _EVEN + " THEN '>' END AS op, "
    "CASE WHEN NOT " + _EVEN + " THEN CAST(k % 100 * 10 AS DOUBLE) END AS value, "
    "CASE WHEN NOT " + _EVEN + " AND k % 20 % 3 = 0 THEN 'Status' END AS when_column, "
    "CASE WHEN NOT " + _EVEN + " AND k % 20 % 3 = 0 THEN 'P' END AS when_value, "
    "CASE WHEN " + _EVEN + f" THEN 'F|o|x' ELSE '' END AS listed FROM ({_RULES})",
    "definitions_merged": "SELECT key, CASE WHEN k % 20 < 3 OR " + _EVEN + " THEN 'values' ELSE 'threshold' END AS kind, "
    "CASE WHEN k % 20 < 3 THEN 'z|y' WHEN " + _EVEN + f" THEN 'F|o|x' ELSE '' END AS listed FROM ({_RULES})",
    "definitions_filter": with_tables(
        "SELECT " + ", ".join(f"count_if({_defined(k)}) AS is_term{k}" for k in range(20)) + " FROM messy_orders", "messy_orders"),
    "definition_rows": with_tables(
        f"SELECT row_id, status, amount FROM messy_orders WHERE {_defined(9)}", "messy_orders"),
    "replace_codes": with_tables(
        f"SELECT row_id, CASE WHEN {trim('doctor')} IN (SELECT 'Dr ' || CAST(s_suppkey % 60 AS VARCHAR) FROM supplier) "
        f"THEN 'P' || substr({trim('doctor')}, 4) ELSE doctor END AS doctor FROM messy_customer", "messy_customer"),
}
