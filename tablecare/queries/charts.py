"""Chart datasets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import datasets
from .base import blank, derived, fold, num, pct, r2, table, with_tables

ORDERS = "messy_orders"


def _by_priority(spark, folder, how="count", value=None):
    return datasets.categorical(derived(spark, folder, ORDERS), "priority", "row_id", value, how)


def _by_brand(spark, folder, how="count", value=None):
    return datasets.categorical(table(spark, folder, "part"), "p_brand", "p_partkey", value, how)


def dataset_count(spark, folder):
    return datasets.in_order(_by_priority(spark, folder)).select("label", "value")


def _dataset(how):
    def run(spark, folder):
        return _by_priority(spark, folder, how, "amount").points.select("label", "value", "n")

    return run


def dataset_sum_cancelling(spark, folder):
    """Sums of quarters between numbers of 10^18 that cancel."""
    rows = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("priority"), F.explode(F.array(
            F.lit(2.0**60) + F.col("o_custkey") * 1024.0, F.lit(-(2.0**60)) - F.col("o_custkey") * 1024.0, F.col("o_orderkey") % 7 * 0.25,
        )).alias("amount"),
    )
    return datasets.categorical(rows, "priority", "row_id", "amount", "sum").points.select("label", "value", "n")


def dataset_filtered(spark, folder):
    chosen = [[("status", "F"), ("second_priority", "2-high")], [("status", "p")]]
    return datasets.categorical(derived(spark, folder, ORDERS), "tags", "row_id", chosen=chosen).points.select("label", "value")


def dataset_no_data(spark, folder):
    df = derived(spark, folder, ORDERS).withColumn("amount", F.when(F.col("status") == "F", "pending").otherwise(F.col("amount")))
    return datasets.categorical(df, "status", "row_id", "amount", "average").no_data


def dataset_month(spark, folder):
    data = datasets.categorical(derived(spark, folder, ORDERS), "visit_date", "row_id", "amount", "average", bucket="month")
    return datasets.in_order(data).select("label", "value")


def dataset_quarter(spark, folder):
    data = datasets.categorical(table(spark, folder, "orders"), "o_orderdate", "o_orderkey", bucket="quarter")
    return datasets.in_order(data).select("label", "value")


def unreadable_periods(spark, folder):
    return datasets.categorical(derived(spark, folder, ORDERS), "visit_date", "row_id", bucket="month").unreadable_periods


def crosstab(spark, folder):
    return datasets.crosstab(derived(spark, folder, ORDERS), "priority", "status", "row_id").cells.drop("key")


def crosstab_other(spark, folder):
    return datasets.crosstab(table(spark, folder, "part"), "p_type", "p_brand", "p_partkey").cells.drop("key")


def _crosstab(how):
    def run(spark, folder):
        return datasets.crosstab(table(spark, folder, "part"), "p_type", "p_brand", "p_partkey", "p_retailprice", how).cells.drop("key")

    return run


def small_multiples(spark, folder):
    data = datasets.crosstab(table(spark, folder, "part"), "p_brand", "p_type", "p_partkey")
    return datasets.small_multiples(data).drop("key")


def histogram(spark, folder):
    return datasets.histogram(table(spark, folder, "orders"), "o_totalprice")


def histogram_whole(spark, folder):
    return datasets.histogram(derived(spark, folder, ORDERS), "course_days")


def histogram_left_out(spark, folder):
    return datasets.histogram_left_out(derived(spark, folder, ORDERS), "course_days")


def box_dot(spark, folder):
    return datasets.box_dot(
        table(spark, folder, "customer"), "c_nationkey", "c_acctbal", "c_custkey"
    ).drop("first").withColumn("values", F.array_join("values", "|"))


def box_dot_no_data(spark, folder):
    df = derived(spark, folder, ORDERS).withColumn("amount", F.when(F.col("status") == "F", "pending").otherwise(F.col("amount")))
    return datasets.box_dot_no_data(df, "status", "amount")


def pareto(spark, folder):
    return datasets.pareto(_by_brand(spark, folder))


_MIXED_AXIS = (
    "SELECT o_orderkey AS row_id, CASE WHEN o_orderkey < 200 THEN '2024-0' || CAST(1 + o_orderkey % 9 AS STRING) ELSE o_orderpriority END AS label FROM {0}"
)


def pareto_mixed_axis(spark, folder):
    """Labels that look like months for many rows and then do not: no time axis."""
    df = spark.sql(_MIXED_AXIS.format("{orders}"), orders=table(spark, folder, "orders"))
    return datasets.pareto(datasets.categorical(df, "label", "row_id")).select("label", "value")


def pareto_summary(spark, folder):
    return datasets.pareto_summary(datasets.pareto(_by_brand(spark, folder)))


def other_fold(spark, folder):
    data = datasets.categorical(table(spark, folder, "documents"), "source", "doc_id", "n_chars", "sum")
    return datasets.fold_small(data, 5)


def rank_cap(spark, folder):
    return datasets.cap_rank(_by_brand(spark, folder), 5).points.select("label", "value")


def rank_cap_least(spark, folder):
    return datasets.cap_rank(_by_brand(spark, folder, "average", "p_size"), 4, least=True).points.select("label", "value")


def sorted_points(spark, folder):
    return datasets.sort_points(_by_priority(spark, folder), "alpha").select("label", "value")


def scatter_sample(spark, folder):
    return datasets.scatter(table(spark, folder, "orders"), "o_totalprice", "o_custkey", "o_orderkey")


def scatter_small(spark, folder):
    return datasets.scatter(table(spark, folder, "supplier"), "s_acctbal", "s_nationkey", "s_suppkey")


def extreme(spark, folder):
    return datasets.extreme(_by_priority(spark, folder))


def extreme_average(spark, folder):
    return datasets.extreme(_by_brand(spark, folder, "average", "p_retailprice"))


def reference_line(spark, folder):
    return datasets.reference_line(_by_brand(spark, folder))


QUERIES = {
    "dataset_categorical": dataset_count, "dataset_sum": _dataset("sum"), "dataset_average": _dataset("average"),
    "dataset_sum_cancelling": dataset_sum_cancelling, "dataset_median": _dataset("median"), "dataset_filtered": dataset_filtered, "dataset_no_data": dataset_no_data,
    "dataset_month": dataset_month, "dataset_quarter": dataset_quarter, "unreadable_periods": unreadable_periods,
    "crosstab": crosstab, "crosstab_other": crosstab_other, "crosstab_sum": _crosstab("sum"),
    "crosstab_average": _crosstab("average"), "crosstab_median": _crosstab("median"), "small_multiples": small_multiples,
    "histogram": histogram, "histogram_whole": histogram_whole, "histogram_left_out": histogram_left_out, "boxdot": box_dot,
    "boxdot_no_data": box_dot_no_data, "pareto": pareto, "pareto_mixed_axis": pareto_mixed_axis, "pareto_summary": pareto_summary, "other_fold": other_fold,
    "rank_cap": rank_cap, "rank_cap_least": rank_cap_least, "sorted_points": sorted_points, "scatter_sample": scatter_sample,
    "scatter_small": scatter_small, "extreme": extreme, "extreme_average": extreme_average, "reference_line": reference_line,
}

# --- the same in SQL -----------------------------------------------------------------------------


def _points(value, having=""):
    return (
        f"SELECT arg_min(priority, row_id) AS label, {value} AS value, count(x) AS n FROM (SELECT *, {num('amount')} AS x FROM messy_orders) "
        f"WHERE NOT {blank('priority')} GROUP BY {fold('priority')} {having}"
    )


_BRANDS = "SELECT p_brand AS label, CAST(count(*) AS DOUBLE) AS value, min(p_partkey) AS f FROM part GROUP BY 1"
_PARETO = (
    "SELECT row_number() OVER w AS position, label, value, sum(value) OVER w AS cum_value, "
    f"sum(value) OVER w / (SELECT count(*) FROM part) * 100 AS cum_pct FROM ({_BRANDS}) "
    "WINDOW w AS (ORDER BY value DESC, f ROWS UNBOUNDED PRECEDING)"
)
_SLOTS = (
    "slots AS (SELECT p_brand AS b, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) - 1 AS slot, count(*) OVER () AS found FROM part GROUP BY 1), "
    "named AS (SELECT least(slot, 7) AS slot, CASE WHEN slot >= 7 THEN 'Other (' || (found - 7) || ' smaller groups)' ELSE b END AS subgroup, b FROM slots)"
)


def _tab(value, empty):
    return (
        f"WITH {_SLOTS} SELECT g.label, g.slot, g.subgroup, coalesce(v.value, {empty}) AS value FROM "
        "(SELECT DISTINCT p_type AS label, slot, subgroup FROM part, named) g LEFT JOIN "
        f"(SELECT p_type AS label, slot, {value} AS value FROM part JOIN named ON p_brand = b GROUP BY 1, 2) v USING (label, slot)"
    )




def _quantile(p):
    """Type-7 interpolation written out over the sorted values ``l``."""
    at = f"((n - 1) * {p}::DOUBLE)"
    low, high = f"l[CAST(floor({at}) AS BIGINT) + 1]", f"l[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"({low} + ({at} - floor({at})) * ({high} - {low}))"


_BOX = (
    "WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS label, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, "
    "list(c_acctbal ORDER BY c_acctbal) AS l, min(c_acctbal) AS min, max(c_acctbal) AS max, "
    "CASE WHEN count(*) <= 50 THEN string_agg(CAST(c_acctbal AS VARCHAR), '|' ORDER BY c_custkey) END AS values FROM customer GROUP BY c_nationkey) "
    f"SELECT label, n, {r2('m')} AS average, {r2('s')} AS stdev, {r2(_quantile(0.5))} AS median, {r2(_quantile(0.25))} AS q1, {r2(_quantile(0.75))} AS q3, "
    f"{r2(_quantile(0.75) + ' - ' + _quantile(0.25))} AS iqr, min, max, {r2('max - min')} AS range, values FROM g"
)

SQL = {
    "pareto_mixed_axis": "SELECT label, CAST(count(*) AS DOUBLE) AS value FROM (" + _MIXED_AXIS.format("orders").replace("AS STRING", "AS VARCHAR")
    + ") GROUP BY 1",
    "dataset_categorical": with_tables(
        f"SELECT arg_min(priority, row_id) AS label, CAST(count(*) AS DOUBLE) AS value FROM messy_orders WHERE NOT {blank('priority')} GROUP BY {fold('priority')}", ORDERS),
    "dataset_sum": with_tables(_points("sum(x)"), ORDERS),
    "dataset_sum_cancelling": "SELECT o_orderpriority AS label, CAST(sum(o_orderkey % 7) AS DOUBLE) * 0.25 AS value, 3 * count(*) AS n FROM orders GROUP BY 1",
    "dataset_average": with_tables(_points(r2("avg(x)"), "HAVING count(x) > 0"), ORDERS),
    "dataset_median": with_tables(_points(r2("quantile_cont(x, 0.5)"), "HAVING count(x) > 0"), ORDERS),
    "dataset_filtered": with_tables(
        f"SELECT arg_min(tags, row_id) AS label, CAST(count(*) AS DOUBLE) AS value FROM messy_orders WHERE NOT {blank('tags')} AND "
        f"((status = 'F' AND {fold('second_priority')} = '2-high') OR status = 'P') GROUP BY {fold('tags')}", ORDERS),
    "dataset_no_data": "SELECT DISTINCT o_orderstatus AS label FROM orders WHERE o_orderstatus = 'F'",
    "dataset_month": with_tables(
        f"SELECT substr(visit_date, 1, 7) AS label, {r2('avg(x)')} AS value FROM (SELECT *, {num('amount')} AS x FROM messy_orders) "
        "WHERE regexp_matches(visit_date, '^\\d{4}-\\d{2}') GROUP BY 1 HAVING count(x) > 0", ORDERS),
    "dataset_quarter": "SELECT CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS label, "
    "CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY 1",
    "unreadable_periods": with_tables(
        "SELECT DISTINCT visit_date AS value FROM messy_orders WHERE visit_date IS NOT NULL AND NOT regexp_matches(visit_date, '^\\d{4}-\\d{2}')", ORDERS),
    "crosstab": with_tables(
        f", c AS (SELECT priority, {fold('priority')} AS k, status, row_id FROM messy_orders WHERE NOT {blank('priority')}), "
        "s AS (SELECT status AS subgroup, row_number() OVER (ORDER BY count(*) DESC, min(row_id)) - 1 AS slot FROM c GROUP BY 1), "
        "l AS (SELECT k, arg_min(priority, row_id) AS label FROM c GROUP BY 1) "
        "SELECT l.label, s.slot, s.subgroup, CAST((SELECT count(*) FROM c WHERE c.k = l.k AND c.status = s.subgroup) AS DOUBLE) AS value FROM l, s", ORDERS),
    "crosstab_other": _tab("CAST(count(*) AS DOUBLE)", "0"), "crosstab_sum": _tab("sum(p_retailprice)", "0"),
    "crosstab_average": _tab(r2("avg(p_retailprice)"), "NULL"),
    "crosstab_median": _tab(r2("quantile_cont(p_retailprice, 0.5)"), "NULL"),
    "small_multiples": (
        "WITH l AS (SELECT p_brand AS label, count(*) AS rows FROM part GROUP BY 1 ORDER BY count(*) DESC, min(p_partkey) LIMIT 12), "
        "s AS (SELECT p_type AS subgroup, row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) - 1 AS slot FROM part GROUP BY 1), "
        "v AS (SELECT l.label, l.rows, s.slot, s.subgroup, CAST((SELECT count(*) FROM part WHERE p_brand = l.label AND p_type = s.subgroup) AS DOUBLE) AS value FROM l, s) "
        "SELECT *, max(value) OVER () AS max_value, (SELECT count(DISTINCT p_brand) - 12 FROM part) AS hidden FROM v"
    ),
    "histogram": (
        "WITH f AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, (max(o_totalprice) - min(o_totalprice)) / 10 AS raw FROM orders), "
        "p AS (SELECT *, pow(10, floor(log10(raw))) AS mag FROM f), w AS (SELECT *, mag * CASE WHEN raw / mag < 1.5 THEN 1 WHEN raw / mag < 3 THEN 2 "
        "WHEN raw / mag < 7 THEN 5 ELSE 10 END AS width FROM p), "
        "b AS (SELECT *, floor(lo / width) * width AS start, CAST(round((ceil(hi / width) * width - floor(lo / width) * width) / width) AS INTEGER) AS bins FROM w), "
        "c AS (SELECT least(CAST(floor((o_totalprice - start) / width) AS INTEGER), bins - 1) AS bin, count(*) AS n FROM orders, b GROUP BY 1), "
        "e AS (SELECT unnest(range(bins)) AS bin, start, width FROM b) "
        "SELECT e.bin, start + e.bin * width AS \"from\", start + (e.bin + 1) * width AS \"to\", coalesce(c.n, 0) AS n, width FROM e LEFT JOIN c USING (bin)"
    ),
    "histogram_whole": with_tables(
        f", v AS (SELECT {num('course_days')} AS x FROM messy_orders), f AS (SELECT CAST(min(x) AS BIGINT) AS lo, CAST(max(x) AS BIGINT) AS hi FROM v), e AS (SELECT lo, unnest(range(lo, hi + 1)) AS edge FROM f) "
        "SELECT edge - lo AS bin, CAST(edge AS DOUBLE) AS \"from\", CAST(edge + 1 AS DOUBLE) AS \"to\", (SELECT count(*) FROM v WHERE x = edge) AS n, "
        "CAST(1 AS DOUBLE) AS width FROM e", ORDERS),
    "histogram_left_out": with_tables(
        "SELECT count_if(course_days = 'N/A') AS unreadable, count_if(course_days <> 'N/A') AS n FROM messy_orders", ORDERS),
    "boxdot": _BOX, "boxdot_no_data": "SELECT DISTINCT lower(o_orderstatus) AS label FROM orders WHERE o_orderstatus = 'F'",
    "pareto": _PARETO,
    "pareto_summary": f"SELECT min(position) FILTER (WHERE cum_pct >= 80) AS k, count(*) AS of, "
    f"CAST(floor(min(cum_pct) FILTER (WHERE cum_pct >= 80) + 0.5) AS BIGINT) AS pct FROM ({_PARETO})",
    "other_fold": (
        "WITH g AS (SELECT source AS label, CAST(sum(n_chars) AS DOUBLE) AS value FROM documents GROUP BY 1), "
        "m AS (SELECT *, value / (SELECT sum(value) FROM g) * 100 < 5 AS small FROM g), k AS (SELECT count_if(small) AS c FROM m) "
        "SELECT CASE WHEN small AND c >= 2 THEN 'Other (' || c || ' smaller groups)' ELSE label END AS label, sum(value) AS value FROM m, k GROUP BY 1"
    ),
    "rank_cap": f"SELECT label, value FROM (SELECT *, rank() OVER (ORDER BY value DESC) AS rk FROM ({_BRANDS})) WHERE rk <= 5",
    "rank_cap_least": f"SELECT label, value FROM (SELECT p_brand AS label, {r2('avg(p_size)')} AS value, rank() OVER (ORDER BY {r2('avg(p_size)')}) AS rk "
    "FROM part GROUP BY 1) WHERE rk <= 4",
    "sorted_points": with_tables(
        f"SELECT arg_min(priority, row_id) AS label, CAST(count(*) AS DOUBLE) AS value FROM messy_orders WHERE NOT {blank('priority')} GROUP BY {fold('priority')}", ORDERS),
    "scatter_sample": (
        "WITH p AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS position, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y, count(*) OVER () AS total_points FROM orders) "
        "SELECT p.* FROM p WHERE total_points <= 2000 OR position IN (SELECT CAST(floor(i * ((SELECT count(*) FROM orders) / 2000.0::DOUBLE)) AS BIGINT) FROM range(2000) t(i))"
    ),
    "scatter_small": "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS position, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y, "
    "count(*) OVER () AS total_points FROM supplier",
    "extreme": with_tables(
        f", g AS (SELECT arg_min(priority, row_id) AS label, CAST(count(*) AS DOUBLE) AS value FROM messy_orders WHERE NOT {blank('priority')} GROUP BY {fold('priority')}) "
        "SELECT label, value, 'Most common: ' || label || ' (' || CAST(floor(value / (SELECT sum(value) FROM g) * 100 + 0.5) AS BIGINT) || '%)' AS statement "
        "FROM g WHERE value = (SELECT max(value) FROM g) AND (SELECT count(*) FROM g WHERE value = (SELECT max(value) FROM g)) = 1", ORDERS),
    "extreme_average": f"WITH g AS (SELECT p_brand AS label, {r2('avg(p_retailprice)')} AS value FROM part GROUP BY 1) "
    "SELECT label, value, 'Highest average: ' || label || ' (' || CAST(value AS VARCHAR) || ')' AS statement FROM g "
    "WHERE value = (SELECT max(value) FROM g) AND (SELECT count(*) FROM g WHERE value = (SELECT max(value) FROM g)) = 1",
    "reference_line": f"SELECT {r2('avg(value)')} AS value FROM ({_BRANDS})",
}
