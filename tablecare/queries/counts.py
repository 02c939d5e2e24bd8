"""Funnels, shares, statistics, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregate, ranking
from ..operators.conditions import (
    all_of, entity_flags, equals, filter_groups_test, keep, keep_listed, missing, one_of, present, threshold,
)
from ..operators.quantiles import exact_quantiles
from .base import blank, derived, fold, missing as missing_sql, num, pct, plain, r2, table, trim, with_tables

STAGES = [equals("o_orderstatus", "f"), equals("o_orderpriority", " 1-urgent"), threshold("o_totalprice", ">", 100000)]
MESSY_STAGES = [
    one_of("priority", ["1-urgent", "2-high"]), threshold("amount", ">=", 20, when=("status", "f")),
    equals("second_priority", "2-high", negated=True),
]
GROUPS = [[("o_orderstatus", "F"), ("o_orderpriority", "1-URGENT")], [("o_orderpriority", "5-low")], []]


def cohort_funnel(spark, folder):
    return aggregate.funnel(table(spark, folder, "orders"), STAGES)


def cohort_funnel_messy(spark, folder):
    return aggregate.funnel(derived(spark, folder, "messy_orders"), MESSY_STAGES)


def cohort_funnel_by_entity(spark, folder):
    return aggregate.entity_funnel(derived(spark, folder, "messy_orders"), "patient_id", MESSY_STAGES)


def entity_tests(spark, folder):
    conditions = [equals("status", "F"), equals("status", "F", negated=True), one_of("status", ["F", "O"], negated=True)]
    return entity_flags(derived(spark, folder, "messy_orders"), "patient_id", conditions).select(
        "entity_key", "pass_0", "pass_1", "pass_2"
    )


def group_share(spark, folder):
    return aggregate.group_share(
        derived(spark, folder, "messy_orders"), "priority", "row_id", [equals("status", "O")]
    ).drop("first")


def filter_groups(spark, folder):
    orders = table(spark, folder, "orders")
    return orders.filter(filter_groups_test(orders, GROUPS)).groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count(F.lit(1)).alias("n")
    )


def preview_count(spark, folder):
    return aggregate.preview_count(table(spark, folder, "orders"), GROUPS)


def preview_tally(spark, folder):
    return aggregate.preview_tally(derived(spark, folder, "messy_orders"), [], ["priority", "status"], "row_id")


def predicates_null_negation(spark, folder):
    df = derived(spark, folder, "messy_orders")
    tests = {
        "p1": equals("priority", "2-high"), "p2": equals("priority", "2-high", negated=True),
        "p3": one_of("priority", ["1-Urgent", "5-LOW"]), "p4": one_of("priority", ["1-Urgent", "5-LOW"], negated=True),
        "p5": threshold("amount", ">", 100), "p5n": threshold("amount", ">", 100).negate(),
        "p6": threshold("amount", "<=", 30, when=("status", " o")), "p7": missing("priority"), "p7n": present("priority"),
        "p10": equals("status", "F").negate(),
    }
    return df.agg(*[F.count_if(c.test(df)).alias(k) for k, c in tests.items()])


def listed_rows(spark, folder):
    wanted = table(spark, folder, "customer").filter("c_acctbal > 9000").selectExpr("'c' || c_custkey AS id")
    df = derived(spark, folder, "messy_orders")
    inside = keep_listed(df, "patient_id", wanted, "id").groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    outside = keep_listed(df, "patient_id", wanted, "id", negated=True).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return inside.withColumn("side", F.lit("in")).unionByName(outside.withColumn("side", F.lit("out")))


def rows_behind(spark, folder):
    return keep(derived(spark, folder, "messy_orders"), MESSY_STAGES).select("row_id", "priority", "amount")


def n_percent(spark, folder):
    return aggregate.last_stage_text(aggregate.funnel(derived(spark, folder, "messy_orders"), MESSY_STAGES))


def stats_by_group(spark, folder):
    return aggregate.summarise(
        table(spark, folder, "lineitem"), "l_extendedprice",
        ["sum", "average", "stdev", "quartiles", "min", "max", "range"], "l_returnflag", ["l_orderkey", "l_linenumber"],
    ).drop("first")


def stats_messy(spark, folder):
    return aggregate.summarise(
        derived(spark, folder, "messy_orders"), "amount", ["sum", "average", "stdev", "quartiles", "min", "max", "distinct"],
        "priority", "row_id",
    ).drop("first")


def stats_overall(spark, folder):
    return aggregate.summarise(
        derived(spark, folder, "messy_orders"), "amount", ["sum", "average", "stdev", "quartiles", "range", "distinct"]
    )


def quantiles_by_group(spark, folder):
    """The distributed quantiles, whatever the input size."""
    return exact_quantiles(
        table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p01": 0.01, "median": 0.5, "p99": 0.99}
    )


def quantiles_overall(spark, folder):
    return exact_quantiles(table(spark, folder, "events"), [], "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})


def describe(spark, folder):
    return aggregate.describe(derived(spark, folder, "messy_orders"), "amount", "status", "row_id")


def describe_duration(spark, folder):
    return aggregate.describe(derived(spark, folder, "messy_orders"), "course_days")


def table1(spark, folder):
    return aggregate.table1(
        derived(spark, folder, "messy_orders"), ["status", "amount", "priority", "course_days"], "row_id",
        numeric=["amount", "course_days"],
    )


def distinct_folded(spark, folder):
    return aggregate.distinct_count(derived(spark, folder, "messy_orders"), "patient_id", ["status"])


def companion_stat(spark, folder):
    return aggregate.summarise(table(spark, folder, "part"), "p_retailprice", ["average", "median"], "p_brand", "p_partkey").drop("first")


def value_frequencies(spark, folder):
    return aggregate.value_counts(derived(spark, folder, "messy_orders"), "tags", "row_id")


def levels(spark, folder):
    return aggregate.levels(derived(spark, folder, "messy_orders"), "priority", "row_id")


def _pooled(policy):
    def run(spark, folder):
        return ranking.top_pooled(
            derived(spark, folder, "messy_orders"), ["priority", "second_priority"], "row_id", policy,
            entity="patient_id" if policy == "entity" else None,
        ).drop("first")

    return run


def pooled_totals(spark, folder):
    return aggregate.pooled_totals(derived(spark, folder, "messy_orders"), ["priority", "second_priority"], "patient_id")


def top_frequency(spark, folder):
    return ranking.top_frequency(derived(spark, folder, "messy_orders"), "patient_id", "row_id", n=10).drop("first")


def least_frequency(spark, folder):
    return ranking.top_frequency(derived(spark, folder, "messy_orders"), "priority", "row_id", n=2, least=True).drop("first")


def top_magnitude(spark, folder):
    return ranking.top_magnitude(table(spark, folder, "lineitem"), "l_quantity", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], n=25).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "Rank"
    )


def top_magnitude_messy(spark, folder):
    return ranking.top_magnitude(derived(spark, folder, "messy_orders"), "amount", "row_id", n=15, least=True).select(
        "Rank", "row_id", "amount"
    )


def unreadable_numbers(spark, folder):
    return ranking.unreadable_count(derived(spark, folder, "messy_orders"), "amount")


def row_list_sorted(spark, folder):
    return ranking.list_rows(
        derived(spark, folder, "messy_orders"), [equals("status", "P")], "row_id", entity="patient_id", sort=("amount", True)
    ).select("row_id", "patient_id", "amount")


def row_list_plain(spark, folder):
    return ranking.list_rows(table(spark, folder, "orders"), STAGES, "o_orderkey", sort=("o_totalprice", False))


QUERIES = {
    "cohort_funnel": cohort_funnel, "cohort_funnel_messy": cohort_funnel_messy,
    "cohort_funnel_by_entity": cohort_funnel_by_entity, "entity_tests": entity_tests, "group_share": group_share,
    "filter_groups": filter_groups, "preview_count": preview_count, "preview_tally": preview_tally,
    "predicates_null_negation": predicates_null_negation, "listed_rows": listed_rows, "rows_behind": rows_behind,
    "n_percent": n_percent, "stats_by_group": stats_by_group, "stats_messy": stats_messy, "stats_overall": stats_overall,
    "quantiles_by_group": quantiles_by_group, "quantiles_overall": quantiles_overall,
    "describe": describe, "describe_duration": describe_duration, "table1": table1, "distinct_folded": distinct_folded,
    "companion_stat": companion_stat, "value_frequencies": value_frequencies, "levels": levels,
    "pooled_rank_occurrence": _pooled("occurrence"), "pooled_rank_row": _pooled("row"),
    "pooled_rank_entity": _pooled("entity"), "pooled_totals": pooled_totals, "top_frequency": top_frequency,
    "least_frequency": least_frequency, "top_magnitude": top_magnitude, "top_magnitude_messy": top_magnitude_messy,
    "unreadable_numbers": unreadable_numbers, "row_list_sorted": row_list_sorted, "row_list_plain": row_list_plain,
}


# --- the same in SQL -----------------------------------------------------------------------


def _stages(names, phrases, unreadable, blanks):
    rows = []
    for i in range(1, len(phrases) + 1):
        rows.append(
            f"SELECT CAST({i} AS INTEGER) AS stage, '{phrases[i - 1]}' AS checked, {names}{i} AS matched, {names}{i - 1} AS out_of, "
            f"{pct(f'{names}{i}', f'{names}{i - 1}')} AS share_pct, {unreadable[i - 1]} AS unreadable, {blanks[i - 1]} AS blank_cells FROM t"
        )
    return " UNION ALL ".join(rows)


_MESSY_PHRASES = ["priority in (1-urgent, 2-high)", "amount >= 20 when status = f", "second_priority is not 2-high"]
_S1 = f"coalesce({fold('priority')} IN ('1-urgent', '2-high'), false)"
_S2 = f"(lower(status) = 'f' AND coalesce({num('amount')} >= 20, false))"
_S3 = f"(second_priority IS NULL OR {fold('second_priority')} <> '2-high')"
_U2 = f"(lower(status) = 'f' AND {num('amount')} IS NULL)"

SQL = {
    "cohort_funnel": "WITH t AS (SELECT count(*) AS a0, count_if(o_orderstatus = 'F') AS a1, "
    "count_if(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS a2, "
    "count_if(o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000) AS a3 FROM orders) "
    + _stages("a", ["o_orderstatus = f", "o_orderpriority =  1-urgent", "o_totalprice > 100000"], ["0"] * 3, ["0"] * 3),
    "cohort_funnel_messy": with_tables(
        f", t AS (SELECT count(*) AS a0, count_if({_S1}) AS a1, count_if({_S1} AND {_S2}) AS a2, "
        f"count_if({_S1} AND {_S2} AND {_S3}) AS a3, count_if({_S1} AND {_U2}) AS u2, "
        f"count_if({blank('priority')}) AS b1, count_if({_S1} AND {_S2} AND {blank('second_priority')}) AS b3 FROM messy_orders) "
        + _stages("a", _MESSY_PHRASES, ["0", "u2", "0"], ["b1", "0", "b3"]), "messy_orders"
    ),
    "cohort_funnel_by_entity": with_tables(
        f", e AS (SELECT {fold('patient_id')} AS k, bool_or({_S1}) AS p1, bool_or({_S2}) AS p2, "
        f"NOT bool_or(coalesce({fold('second_priority')} = '2-high', false)) AS p3, count_if({_U2}) AS u "
        f"FROM messy_orders WHERE NOT {blank('patient_id')} GROUP BY 1), "
        "t AS (SELECT count(*) AS a0, count_if(p1) AS a1, count_if(p1 AND p2) AS a2, count_if(p1 AND p2 AND p3) AS a3, "
        "CAST(coalesce(sum(u) FILTER (WHERE p1), 0) AS BIGINT) AS u2 FROM e) "
        + _stages("a", _MESSY_PHRASES, ["0", "u2", "0"], ["0"] * 3), "messy_orders"
    ),
    "entity_tests": with_tables(
        f"SELECT {fold('patient_id')} AS entity_key, bool_or(status = 'F') AS pass_0, NOT bool_or(status = 'F') AS pass_1, "
        f"NOT bool_or(status IN ('F', 'O')) AS pass_2 FROM messy_orders WHERE NOT {blank('patient_id')} GROUP BY 1", "messy_orders"),
    "group_share": with_tables(
        f"SELECT arg_min(priority, row_id) AS label, count(*) AS n, "
        f"{pct('count(*)', '(SELECT count(*) FROM messy_orders WHERE status = $$O$$)')} AS share_pct "
        f"FROM messy_orders WHERE status = 'O' AND NOT {blank('priority')} GROUP BY {fold('priority')}", "messy_orders"),
    "filter_groups": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders "
    "WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderpriority = '5-LOW' GROUP BY 1, 2",
    "preview_count": "SELECT count(*) AS rows FROM orders "
    "WHERE (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') OR o_orderpriority = '5-LOW'",
    "preview_tally": with_tables(
        f"SELECT arg_min(priority || ' / ' || status, row_id) AS label, count(*) AS n FROM messy_orders "
        f"WHERE NOT {blank('priority')} GROUP BY {fold('priority')}, status", "messy_orders"),
    "predicates_null_negation": with_tables(
        f"SELECT count_if({fold('priority')} = '2-high') AS p1, count_if(priority IS NULL OR {fold('priority')} <> '2-high') AS p2, "
        f"count_if({fold('priority')} IN ('1-urgent', '5-low')) AS p3, "
        f"count_if(priority IS NULL OR {fold('priority')} NOT IN ('1-urgent', '5-low')) AS p4, "
        f"count_if({num('amount')} > 100) AS p5, count_if({num('amount')} <= 100) AS p5n, "
        f"count_if({num('amount')} <= 30 AND status = 'O') AS p6, count_if({missing_sql('priority')}) AS p7, "
        f"count_if(NOT {missing_sql('priority')}) AS p7n, count_if(status <> 'F') AS p10 FROM messy_orders", "messy_orders"),
    "listed_rows": with_tables(
        f", w AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_acctbal > 9000) "
        f"SELECT status, count(*) AS n, 'in' AS side FROM messy_orders WHERE {fold('patient_id')} IN (SELECT id FROM w) GROUP BY 1 "
        f"UNION ALL SELECT status, count(*) AS n, 'out' AS side FROM messy_orders "
        f"WHERE patient_id IS NULL OR {fold('patient_id')} NOT IN (SELECT id FROM w) GROUP BY 1", "messy_orders"),
    "rows_behind": with_tables(
        f"SELECT row_id, priority, amount FROM messy_orders WHERE {_S1} AND {_S2} AND {_S3}", "messy_orders"),
    "n_percent": with_tables(
        f", t AS (SELECT count_if({_S1} AND {_S2}) AS d, count_if({_S1} AND {_S2} AND {_S3}) AS n, "
        f"count_if({_S1} AND {_S2} AND {blank('second_priority')}) AS b FROM messy_orders) "
        f"SELECT CAST(n AS VARCHAR) || ' (' || {plain(pct('n', 'd'))} || '%)' AS n_percent, d AS out_of, b AS blank_cells FROM t",
        "messy_orders"),
}


def _bundle(x):
    return (
        f"count(*) AS rows, count({x}) AS n, count(*) - count({x}) AS skipped, CAST(sum(CAST({x} AS DECIMAL(20,6))) AS DOUBLE) AS sum, {r2(f'avg({x})')} AS average, "
        f"{r2(f'stddev_samp({x})')} AS stdev, {r2(f'quantile_cont({x}, 0.25)')} AS q1, {r2(f'quantile_cont({x}, 0.5)')} AS median, "
        f"{r2(f'quantile_cont({x}, 0.75)')} AS q3, {r2(f'quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)')} AS iqr, "
        f"min({x}) AS min, max({x}) AS max, {r2(f'max({x}) - min({x})')} AS range"
    )


def _describe(x, unit=""):
    return (
        "n, skipped AS missing, "
        f"{plain('average')} || ' (SD ' || {plain('stdev')} || ')' AS mean_sd, "
        f"{plain('median')} || ' (IQR ' || {plain('q1')} || '–' || {plain('q3')} || ')' AS median_iqr, "
        f"{plain('min')} || '–' || {plain('max')} || '{unit}' AS min_max"
    )


def _freq(column, extra=""):
    return (
        f"SELECT arg_min({column}, row_id) AS label, count(*) AS n, min(row_id) AS first FROM messy_orders "
        f"WHERE NOT {blank(column)} {extra} GROUP BY {fold(column)}"
    )


def _table1_cat(position, column):
    return (
        f"SELECT {position} AS position, '{column} — n (%)' AS characteristic, '' AS summary, count_if({blank(column)}) AS missing FROM messy_orders "
        f"UNION ALL SELECT {position}, '  ' || label, CAST(n AS VARCHAR) || ' (' || {plain(pct('n', 'd'))} || '%)', NULL FROM "
        f"(SELECT *, sum(n) OVER () AS d FROM ({_freq(column)}))"
    )


def _table1_num(position, column, unit):
    return (
        f"SELECT {position}, '{column}', 'median ' || {plain('median')} || '{unit} (IQR ' || {plain('q1')} || '–' || {plain('q3')} || "
        f"'); mean ' || {plain('average')} || ' (SD ' || {plain('stdev')} || ')', skipped FROM "
        f"(SELECT {_bundle('x')} FROM (SELECT {num(column)} AS x FROM messy_orders))"
    )


_POOL = (
    "SELECT row_id, patient_id, 0 AS place, priority AS v FROM messy_orders UNION ALL "
    "SELECT row_id, patient_id, 1 AS place, second_priority AS v FROM messy_orders"
)


def _pool_sql(distinct):
    """Mentions reduced to one per ``distinct`` key, then ranked."""
    base = f"SELECT *, {fold('v')} AS k FROM ({_POOL}) WHERE NOT {blank('v')}"
    if distinct:
        base = (
            f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {distinct}, k ORDER BY row_id, place) AS rn FROM ({base})) WHERE rn = 1"
        )
    return with_tables(
        f"SELECT label, n, {pct('n', 'sum(n) OVER ()')} AS share_pct FROM "
        f"(SELECT arg_min(v, row_id * 2 + place) AS label, count(*) AS n FROM ({base}) GROUP BY k)", "messy_orders")


SQL |= {
    "quantiles_by_group": "SELECT l_returnflag, quantile_cont(l_extendedprice, 0.01) AS p01, quantile_cont(l_extendedprice, 0.5) AS median, "
    "quantile_cont(l_extendedprice, 0.99) AS p99 FROM lineitem GROUP BY 1",
    "quantiles_overall": "SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events",
    "stats_by_group": "SELECT label, rows, n, skipped, sum, average, stdev, q1, median, q3, iqr, min, max, range FROM "
    f"(SELECT l_returnflag AS label, {_bundle('l_extendedprice')} FROM lineitem GROUP BY 1)",
    "stats_messy": with_tables(
        f"SELECT arg_min(priority, row_id) AS label, {_bundle('x')}, "
        f"count(DISTINCT CASE WHEN NOT {blank('amount')} THEN {fold('amount')} END) AS distinct "
        f"FROM (SELECT *, {num('amount')} AS x FROM messy_orders WHERE NOT {blank('priority')}) GROUP BY {fold('priority')}",
        "messy_orders").replace("SELECT arg_min", "SELECT * EXCLUDE (range) FROM (SELECT arg_min") + ")",
    "stats_overall": with_tables(
        f"SELECT * EXCLUDE (min, max) FROM (SELECT {_bundle('x')}, "
        f"count(DISTINCT CASE WHEN NOT {blank('amount')} THEN {fold('amount')} END) AS distinct "
        f"FROM (SELECT *, {num('amount')} AS x FROM messy_orders))", "messy_orders"),
    "describe": with_tables(
        f"SELECT status AS label, {_describe('x')} FROM (SELECT status, {_bundle('x')} FROM "
        f"(SELECT status, {num('amount')} AS x FROM messy_orders) GROUP BY 1)", "messy_orders"),
    "describe_duration": with_tables(
        f"SELECT {_describe('x', ' days')} FROM (SELECT {_bundle('x')} FROM (SELECT {num('course_days')} AS x FROM messy_orders))",
        "messy_orders"),
    "table1": with_tables(
        " UNION ALL ".join([_table1_cat(0, "status"), _table1_num(1, "amount", ""), _table1_cat(2, "priority"),
                            _table1_num(3, "course_days", " days")]), "messy_orders"),
    "distinct_folded": with_tables(
        f"SELECT status, count(DISTINCT CASE WHEN NOT {blank('patient_id')} THEN {fold('patient_id')} END) AS distinct "
        "FROM messy_orders GROUP BY 1", "messy_orders"),
    "companion_stat": f"SELECT p_brand AS label, count(*) AS rows, count(*) AS n, CAST(0 AS BIGINT) AS skipped, "
    f"{r2('avg(p_retailprice)')} AS average, {r2('quantile_cont(p_retailprice, 0.5)')} AS median FROM part GROUP BY 1",
    "value_frequencies": with_tables(
        f"SELECT {fold('tags')} AS key, arg_min(tags, row_id) AS label, count(*) AS n, min(row_id) AS first FROM messy_orders "
        f"WHERE NOT {blank('tags')} GROUP BY 1", "messy_orders"),
    "levels": with_tables(_freq("priority"), "messy_orders"),
    "pooled_rank_occurrence": _pool_sql(None), "pooled_rank_row": _pool_sql("row_id"),
    "pooled_rank_entity": _pool_sql(
        f"CASE WHEN {blank('patient_id')} THEN 'row ' || CAST(row_id AS VARCHAR) ELSE {fold('patient_id')} END"),
    "pooled_totals": with_tables(
        f"SELECT count(*) AS rows, count_if({blank('priority')}) + count_if({blank('second_priority')}) AS blank_cells, "
        f"count_if({blank('patient_id')}) AS no_entity FROM messy_orders", "messy_orders"),
    "top_frequency": with_tables(
        f"SELECT label, n, {pct('n', 'd')} AS share_pct FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS rk, sum(n) OVER () AS d "
        f"FROM ({_freq('patient_id')})) WHERE rk <= 10", "messy_orders"),
    "least_frequency": with_tables(
        f"SELECT label, n, {pct('n', 'd')} AS share_pct FROM (SELECT *, rank() OVER (ORDER BY n) AS rk, sum(n) OVER () AS d "
        f"FROM ({_freq('priority')})) WHERE rk <= 2", "messy_orders"),
    "top_magnitude": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, row_number() OVER (ORDER BY l_quantity DESC, "
    "l_orderkey, l_linenumber, l_partkey, l_suppkey) AS Rank FROM "
    "(SELECT *, rank() OVER (ORDER BY l_quantity DESC) AS rk FROM lineitem) WHERE rk <= 25",
    "top_magnitude_messy": with_tables(
        f"SELECT row_number() OVER (ORDER BY x, row_id) AS Rank, row_id, amount FROM (SELECT *, rank() OVER (ORDER BY x) AS rk "
        f"FROM (SELECT *, {num('amount')} AS x FROM messy_orders) WHERE x IS NOT NULL) WHERE rk <= 15", "messy_orders"),
    "unreadable_numbers": with_tables(f"SELECT count_if({num('amount')} IS NULL) AS unreadable FROM messy_orders", "messy_orders"),
    "row_list_sorted": with_tables(
        f"SELECT row_id, patient_id, amount FROM (SELECT *, row_number() OVER (PARTITION BY coalesce({fold('patient_id')}, '') "
        "ORDER BY row_id) AS rn FROM messy_orders WHERE status = 'P') WHERE rn = 1", "messy_orders"),
    "row_list_plain": "SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice > 100000",
}
