"""Tests, effect sizes, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.distributions import chi_square_p, fisher_p, normal_p, t_p
from ..functions.distributions import z_for
from ..operators import stats
from ..operators.conditions import equals, threshold
from .base import derived, table, with_tables

Z95 = z_for(0.95)


def _items(spark, folder):
    """Line items with the two-level columns the tests compare."""
    return table(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 100000000 + F.col("l_linenumber") * 10000000 + F.col("l_partkey")).alias("row_id"),
        "l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount",
        F.when(F.col("l_quantity") > 25, "large").otherwise("small").alias("size"),
        F.when(F.col("l_suppkey") % 29 == 0, "rare").otherwise("common").alias("supply"),
    )


def welch(spark, folder):
    return stats.welch(_items(spark, folder), "l_extendedprice", "size", "row_id", ["l_returnflag"]).select(
        "l_returnflag", "group_a", "group_b", "n_a", "n_b", F.round("mean_a", 4).alias("mean_a"), F.round("mean_b", 4).alias("mean_b"),
        F.round("diff", 4).alias("diff"), F.round("t", 6).alias("t"), F.round("df", 3).alias("df"), "status",
    )


def _discounts(spark, folder):
    return stats.welch(_items(spark, folder), "l_discount", "l_linestatus", "row_id", ["l_returnflag"])


def welch_p(spark, folder):
    return _discounts(spark, folder).select("l_returnflag", F.round("t", 6).alias("t"), F.round("p", 7).alias("p"))


def welch_refused(spark, folder):
    items = _items(spark, folder).withColumn("l_quantity", F.when(F.col("l_returnflag") == "A", F.lit(3.0)).otherwise(F.col("l_quantity")))
    items = items.withColumn("size", F.when(F.col("l_returnflag") == "N", "one").otherwise(F.col("size")))
    return stats.welch(items, "l_quantity", "size", "row_id", ["l_returnflag"]).select("l_returnflag", "status")


def contingency_cells(spark, folder):
    return stats.contingency_cells(derived(spark, folder, "messy_orders"), "priority", "status", "row_id").select(
        "a_label", "b_label", "n", "a_total", "b_total", "total", F.round("expected", 6).alias("expected")
    )


def chi_square(spark, folder):
    return stats.contingency(_items(spark, folder), "size", "l_linestatus", "row_id", ["l_returnflag"]).select(
        "l_returnflag", "n", "df", F.round("chi_square", 6).alias("chi_square"), F.round("min_expected", 6).alias("min_expected"),
        "c11", "c12", "c21", "c22", "a_1", "b_1",
    )


def chi_square_large(spark, folder):
    return stats.contingency(derived(spark, folder, "messy_orders"), "priority", "status", "row_id").select(
        "n", "a_levels", "b_levels", "df", F.round("chi_square", 6).alias("chi_square"), F.round("min_expected", 6).alias("min_expected")
    )


def odds_ratio(spark, folder):
    return stats.table_test(_items(spark, folder), "supply", "size", "row_id", ["l_returnflag", "l_linestatus"]).select(
        "l_returnflag", "l_linestatus", *[F.round(c, 8).alias(c) for c in ("odds_ratio", "odds_ratio_lo", "odds_ratio_hi")]
    )


def risk_ratio(spark, folder):
    return stats.table_test(_items(spark, folder), "supply", "size", "row_id", ["l_returnflag", "l_linestatus"]).select(
        "l_returnflag", "l_linestatus", *[F.round(c, 8).alias(c) for c in ("risk_ratio", "risk_ratio_lo", "risk_ratio_hi")]
    )


def _accounts(spark, folder):
    """Customers by nation: small tables, so some go to the exact test."""
    df = table(spark, folder, "customer").select(
        "c_custkey", "c_nationkey", F.when(F.col("c_acctbal") < 0, "debt").otherwise("credit").alias("account"),
        F.when(F.col("c_mktsegment") == "BUILDING", "building").otherwise("other").alias("trade"),
    )
    return stats.table_test(df, "account", "trade", "c_custkey", ["c_nationkey"])


def test_choice(spark, folder):
    return _accounts(spark, folder).select("c_nationkey", "test", F.round("p", 7).alias("p"))


def test_choice_rule(spark, folder):
    return _accounts(spark, folder).select("c_nationkey", "test", "reliable", F.round("min_expected", 6).alias("min_expected"))


def choose_test(spark, folder):
    return stats.choose_test(_items(spark, folder), "l_quantity", "supply", "row_id").select("group_a", "group_b", "n_a", "n_b", "status")


def wilson(spark, folder):
    return stats.proportion(table(spark, folder, "orders"), threshold("o_totalprice", ">", 400000), ["o_orderpriority"]).select(
        "o_orderpriority", "x", "n", *[F.round(c, 10).alias(c) for c in ("proportion", "lo", "hi")]
    )


def fisher(spark, folder):
    cells = _accounts(spark, folder).select("c_nationkey", fisher_p("c11", "c12", "c21", "c22").alias("f"))
    return cells.select("c_nationkey", *[F.round(f"f.{c}", 7).alias(c) for c in ("p", "p_less", "p_greater")])


def mean_diff_ci(spark, folder):
    return _discounts(spark, folder).select("l_returnflag", *[F.round(c, 9).alias(c) for c in ("diff", "lo", "hi")])


def tail_probabilities(spark, folder):
    """Tails with the degrees of freedom that have a closed form, and large ones beside their expansions."""
    facts = table(spark, folder, "events").groupBy("user_id").agg(F.avg("value").alias("m"))
    at = lambda x, df: (x, F.lit(float(df)))
    chi, t = F.col("m") / 20, F.col("m") / 30
    return facts.select(
        "user_id", *[F.round(chi_square_p(*at(chi, d)), 10).alias(f"chi_{d}") for d in (2, 4)],
        *[F.round(t_p(*at(t, d)), 10).alias(f"t_{d}") for d in (1, 2, 4)], F.round(normal_p(t), 7).alias("z"),
        *[F.round(t_p(*at(t, 10**d)), 7).alias(f"t_e{d}") for d in (5, 6, 8)],
        *[F.round(chi_square_p(F.lit(10.0**d) + F.floor("m") * 0, F.lit(10.0**d)), 7).alias(f"chi_e{d}") for d in (5, 6, 8)],
    )


def epv_gate(spark, folder):
    orders = table(spark, folder, "orders")
    event = equals("o_orderpriority", "1-URGENT")
    rare = threshold("o_totalprice", ">", 499000)
    return (
        stats.epv_gate(orders, "yesno", 5, event).unionByName(stats.epv_gate(orders, "yesno", 30, rare))
        .unionByName(stats.epv_gate(orders, "measurement", 3)).unionByName(stats.epv_gate(orders, "time", 2, event, repeated=True))
    )


def glm_linear(spark, folder):
    return stats.regress(table(spark, folder, "lineitem"), "l_extendedprice", ["l_quantity"], "linear").select(
        "term", F.round("estimate", 5).alias("estimate"), F.round("se", 5).alias("se")
    )


def _labelled(spark, folder):
    marked = table(spark, folder, "labels").join(table(spark, folder, "documents").select("doc_id", "n_chars", "lang"), "doc_id")
    return marked.withColumn("kchars", F.col("n_chars") / 1000)


def glm_logistic(spark, folder):
    return stats.regress(_labelled(spark, folder), "quality", ["kchars", "lang"], "logistic")


def glm_logistic_score(spark, folder):
    """What a maximum-likelihood fit leaves: residuals that add up to nothing over every predictor."""
    rows = _labelled(spark, folder)
    fit = {r["term"]: r["estimate"] for r in stats.regress(rows, "quality", ["kchars", "lang"], "logistic").collect()}
    by_level = F.create_map(*[F.lit(x) for t, e in fit.items() for x in (t, e)])
    line = fit["(intercept)"] + fit["kchars"] * F.col("kchars") + F.coalesce(by_level[F.concat(F.lit("lang = "), "lang")], F.lit(0.0))
    left = rows.withColumn("left", F.col("quality") - 1 / (1 + F.exp(-line)))
    per_level = left.groupBy(F.concat(F.lit("lang = "), "lang").alias("term")).agg(F.sum("left").alias("s"), F.count(F.lit(1)).alias("n"))
    over_all = left.agg(F.lit("kchars").alias("term"), F.sum(F.col("left") * F.col("kchars")).alias("s"), F.count(F.lit(1)).alias("n"))
    return per_level.unionByName(over_all).select("term", "n", (F.round(F.abs("s"), 3)).alias("score"))


QUERIES = {
    "welch_t": welch, "welch_p": welch_p, "welch_refused": welch_refused, "contingency_cells": contingency_cells,
    "chi_square": chi_square, "chi_square_large": chi_square_large, "odds_ratio": odds_ratio, "risk_ratio": risk_ratio,
    "test_choice": test_choice, "test_choice_rule": test_choice_rule, "choose_test": choose_test, "wilson": wilson,
    "fisher": fisher, "mean_diff_ci": mean_diff_ci, "tail_probabilities": tail_probabilities, "epv_gate": epv_gate,
    "glm_linear": glm_linear, "glm_logistic": glm_logistic,
    "glm_logistic_score": glm_logistic_score,
}

# --- the same in SQL -----------------------------------------------------------------------------

_ITEMS = (
    "items AS (SELECT l_orderkey * 100000000 + l_linenumber * 10000000 + l_partkey AS row_id, *, "
    "CASE WHEN l_quantity > 25 THEN 'large' ELSE 'small' END AS size, CASE WHEN l_suppkey % 29 = 0 THEN 'rare' ELSE 'common' END AS supply FROM lineitem)"
)


def _two_by_two(source, a, b, by):
    """Cells of the 2 by 2 table whose first levels are those seen first."""
    keys = ", ".join(by)
    return (
        f"ones AS (SELECT {keys}, arg_min({a}, row_id) AS a1, arg_min({b}, row_id) AS b1 FROM {source} GROUP BY ALL), "
        f"t AS (SELECT {keys}, a1, b1, count_if({a} = a1 AND {b} = b1) AS c11, count_if({a} = a1 AND {b} <> b1) AS c12, "
        f"count_if({a} <> a1 AND {b} = b1) AS c21, count_if({a} <> a1 AND {b} <> b1) AS c22, count(*) AS n FROM {source} JOIN ones USING ({keys}) GROUP BY ALL)"
    )


_BOTH = ["l_returnflag", "l_linestatus"]
_FIXED = "f AS (SELECT *, CASE WHEN c11 * c12 * c21 * c22 = 0 THEN 0.5 ELSE 0 END AS h FROM t), g AS (SELECT *, c11 + h AS a, c12 + h AS b, c21 + h AS c, c22 + h AS d FROM f)"


def _ratio(name, value, se):
    return (
        f"SELECT l_returnflag, l_linestatus, round({value}, 8) AS {name}, round(exp(ln({value}) - {Z95}::DOUBLE * {se}), 8) AS {name}_lo, "
        f"round(exp(ln({value}) + {Z95}::DOUBLE * {se}), 8) AS {name}_hi FROM g"
    )


_CUSTOMERS = (
    "cust AS (SELECT c_custkey AS row_id, c_nationkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS account, "
    "CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE 'other' END AS trade FROM customer)"
)
_LEAST = "least(c11 + c12, c21 + c22) * 1.0::DOUBLE * least(c11 + c21, c12 + c22) / n"
_CHI = "n * 1.0::DOUBLE * pow(c11 * c22 - c12 * c21, 2) / ((c11 + c12) * 1.0::DOUBLE * (c21 + c22) * (c11 + c21) * (c12 + c22))"
_EVENTS = "(SELECT count_if(o_orderpriority = '1-URGENT') FROM orders)"
_RARE = "(SELECT count_if(o_totalprice > 499000) FROM orders)"


def _gate(events, predictors, method, decision, reason, suggested="NULL"):
    return (
        f"SELECT {events} AS events, {predictors} AS predictors, {events} / {predictors}::DOUBLE AS epv, '{method}' AS method, "
        f"{decision} AS decision, {reason} AS reason, CAST({suggested} AS BIGINT) AS suggested"
    )


_FEW = "'too few events'"
_MESSY = (
    ", o AS (SELECT regexp_replace(lower(regexp_replace(priority, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g') AS k, priority, status, row_id FROM messy_orders "
    "WHERE trim(priority) <> ''), c AS (SELECT k, status, count(*) AS n FROM o GROUP BY 1, 2), "
    "e AS (SELECT *, sum(n) OVER (PARTITION BY k) AS a_total, sum(n) OVER (PARTITION BY status) AS b_total, sum(n) OVER () AS total FROM c) "
)

# The area under a density between 0 and ``x``, by Simpson's rule with 400 steps.
def _area(density, x):
    steps = "range(401)"
    weight = "CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    at = f"(i * {x} / 400.0::DOUBLE)"
    return f"(SELECT sum({weight} * {density.format(u=at)}) * {x} / 1200.0::DOUBLE FROM {steps} s(i))"


_NORMAL = "exp(-{u} * {u} / 2) / sqrt(2 * pi())"
_T = "exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(df * pi()) * pow(1 + {u} * {u} / df, -(df + 1) / 2)"
_GROUPS = (
    f"{_ITEMS}, g AS (SELECT l_returnflag, l_linestatus AS k, count(*) AS n, avg(l_discount) AS m, var_samp(l_discount) AS v, "
    "row_number() OVER (PARTITION BY l_returnflag ORDER BY min(row_id)) AS place FROM items GROUP BY 1, 2), "
    "w AS (SELECT l_returnflag, a.m - b.m AS diff, sqrt(a.v / a.n + b.v / b.n) AS se, (a.m - b.m) / sqrt(a.v / a.n + b.v / b.n) AS t, "
    "pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)) AS df "
    "FROM (SELECT * FROM g WHERE place = 1) a JOIN (SELECT * FROM g WHERE place = 2) b USING (l_returnflag))"
)
_CHOOSE = "lgamma({m} + 1.0::DOUBLE) - lgamma({k} + 1.0::DOUBLE) - lgamma({m} - ({k}) + 1.0::DOUBLE)"


def _hyper(x):
    ways = [_CHOOSE.format(m="r1", k=x), _CHOOSE.format(m="(n - r1)", k=f"(k1 - {x})"), _CHOOSE.format(m="n", k="k1")]
    return f"exp({ways[0]} + {ways[1]} - ({ways[2]}))"


_EXACT = (
    "r AS (SELECT *, c11 + c12 AS r1, c11 + c21 AS k1 FROM t WHERE c11 + c12 > 0 AND c21 + c22 > 0 AND c11 + c21 > 0 AND c12 + c22 > 0), "
    "x AS (SELECT *, unnest(range(CAST(greatest(0, r1 + k1 - n) AS BIGINT), CAST(least(r1, k1) + 1 AS BIGINT))) AS x FROM r), "
    f"y AS (SELECT *, {_hyper('x')} AS px, {_hyper('c11')} AS seen FROM x), "
    "fisher AS (SELECT c_nationkey, least(1, sum(px) FILTER (WHERE px <= seen * (1 + 1e-7))) AS p, "
    "least(1, sum(px) FILTER (WHERE x <= c11)) AS p_less, least(1, sum(px) FILTER (WHERE x >= c11)) AS p_greater FROM y GROUP BY 1)"
)
_Z3 = "(z + (pow(z, 3) + z) / (4 * df) + (5 * pow(z, 5) + 16 * pow(z, 3) + 3 * z) / (96 * df * df))"

SQL = {
    "welch_p": f"WITH {_GROUPS} SELECT l_returnflag, round(t, 6) AS t, round(1 - 2 * {_area(_T, 'abs(t)')}, 7) AS p FROM w",
    "mean_diff_ci": f"WITH {_GROUPS}, z AS (SELECT *, {Z95}::DOUBLE AS z FROM w) SELECT l_returnflag, round(diff, 9) AS diff, "
    f"round(diff - {_Z3} * se, 9) AS lo, round(diff + {_Z3} * se, 9) AS hi FROM z",
    "fisher": f"WITH {_CUSTOMERS}, {_two_by_two('cust', 'account', 'trade', ['c_nationkey'])}, {_EXACT} "
    "SELECT c_nationkey, round(p, 7) AS p, round(p_less, 7) AS p_less, round(p_greater, 7) AS p_greater FROM fisher",
    "test_choice": f"WITH {_CUSTOMERS}, {_two_by_two('cust', 'account', 'trade', ['c_nationkey'])}, {_EXACT}, c AS (SELECT *, sqrt({_CHI}) AS q FROM r) "
    f"SELECT c_nationkey, CASE WHEN {_LEAST} < 5 THEN 'fisher' ELSE 'chi-square' END AS test, "
    f"round(CASE WHEN {_LEAST} < 5 THEN p ELSE 1 - 2 * {_area(_NORMAL, 'q')} END, 7) AS p FROM c JOIN fisher USING (c_nationkey)",
    "glm_logistic_score": "WITH m AS (SELECT lang FROM labels JOIN documents USING (doc_id)) "
    "SELECT 'lang = ' || lang AS term, count(*) AS n, 0.0::DOUBLE AS score FROM m GROUP BY 1 UNION ALL SELECT 'kchars', count(*), 0.0 FROM m",
    "tail_probabilities": "WITH m AS (SELECT user_id, avg(value) / 20 AS x, avg(value) / 30 AS t FROM events GROUP BY 1) "
    "SELECT user_id, round(exp(-x / 2), 10) AS chi_2, round(exp(-x / 2) * (1 + x / 2), 10) AS chi_4, round(1 - 2 / pi() * atan(t), 10) AS t_1, "
    "round(1 - t / sqrt(t * t + 2), 10) AS t_2, round(1 - t * (t * t + 6) / pow(t * t + 4, 1.5), 10) AS t_4, "
    f"round(1 - 2 * {_area(_NORMAL, 't')}, 7) AS z, "
    + ", ".join(f"round(1 - 2 * {_area(_NORMAL, 't')} + exp(-t * t / 2) / sqrt(2 * pi()) * t * (t * t + 1) / 2e{d}, 7) AS t_e{d}" for d in (5, 6, 8))
    + ", " + ", ".join(f"round(0.5::DOUBLE - 1 / (3 * sqrt(pi() * 1e{d})), 7) AS chi_e{d}" for d in (5, 6, 8)) + " FROM m",
    "welch_t": f"WITH {_ITEMS}, g AS (SELECT l_returnflag, size, count(*) AS n, avg(l_extendedprice) AS m, var_samp(l_extendedprice) AS v, "
    "row_number() OVER (PARTITION BY l_returnflag ORDER BY min(row_id)) AS place FROM items GROUP BY 1, 2) "
    "SELECT l_returnflag, a.size AS group_a, b.size AS group_b, a.n AS n_a, b.n AS n_b, round(a.m, 4) AS mean_a, round(b.m, 4) AS mean_b, "
    "round(a.m - b.m, 4) AS diff, round((a.m - b.m) / sqrt(a.v / a.n + b.v / b.n), 6) AS t, "
    "round(pow(a.v / a.n + b.v / b.n, 2) / (pow(a.v / a.n, 2) / (a.n - 1) + pow(b.v / b.n, 2) / (b.n - 1)), 3) AS df, 'ok' AS status "
    "FROM (SELECT * FROM g WHERE place = 1) a JOIN (SELECT * FROM g WHERE place = 2) b USING (l_returnflag)",
    "welch_refused": "SELECT DISTINCT l_returnflag, CASE l_returnflag WHEN 'A' THEN 'no variation to test' WHEN 'N' THEN 'needs exactly two groups' "
    "ELSE 'ok' END AS status FROM lineitem",
    "contingency_cells": with_tables(
        _MESSY + "SELECT (SELECT arg_min(priority, row_id) FROM o WHERE o.k = e.k) AS a_label, status AS b_label, n, CAST(a_total AS BIGINT) AS a_total, CAST(b_total AS BIGINT) AS b_total, CAST(total AS BIGINT) AS total, "
        "round(a_total * 1.0::DOUBLE * b_total / total, 6) AS expected FROM e", "messy_orders"),
    "chi_square": f"WITH {_ITEMS}, {_two_by_two('items', 'size', 'l_linestatus', ['l_returnflag'])} "
    f"SELECT l_returnflag, n, 1 AS df, round({_CHI}, 6) AS chi_square, round({_LEAST}, 6) AS min_expected, c11, c12, c21, c22, a1 AS a_1, b1 AS b_1 FROM t",
    "chi_square_large": with_tables(
        _MESSY + "SELECT CAST(max(total) AS BIGINT) AS n, count(DISTINCT k) AS a_levels, count(DISTINCT status) AS b_levels, "
        "(count(DISTINCT k) - 1) * (count(DISTINCT status) - 1) AS df, round(sum(pow(n - a_total * 1.0::DOUBLE * b_total / total, 2) / (a_total * 1.0::DOUBLE * b_total / total)), 6) "
        "AS chi_square, round(min(a_total) * 1.0::DOUBLE * min(b_total) / max(total), 6) AS min_expected FROM e", "messy_orders"),
    "odds_ratio": f"WITH {_ITEMS}, {_two_by_two('items', 'supply', 'size', _BOTH)}, {_FIXED} "
    + _ratio("odds_ratio", "(a * d / (b * c)::DOUBLE)", "sqrt(1 / a + 1 / b + 1 / c + 1 / d)"),
    "risk_ratio": f"WITH {_ITEMS}, {_two_by_two('items', 'supply', 'size', _BOTH)}, {_FIXED} "
    + _ratio("risk_ratio", "((a / (a + b)) / (c / (c + d)))", "sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d))"),
    "test_choice_rule": f"WITH {_CUSTOMERS}, {_two_by_two('cust', 'account', 'trade', ['c_nationkey'])} "
    f"SELECT c_nationkey, CASE WHEN {_LEAST} < 5 THEN 'fisher' ELSE 'chi-square' END AS test, {_LEAST} >= 5 AS reliable, round({_LEAST}, 6) AS min_expected "
    "FROM t WHERE c11 + c12 > 0 AND c21 + c22 > 0 AND c11 + c21 > 0 AND c12 + c22 > 0",
    "choose_test": f"WITH {_ITEMS}, g AS (SELECT supply, count(*) AS n, row_number() OVER (ORDER BY min(row_id)) AS place FROM items GROUP BY 1) "
    "SELECT max(supply) FILTER (WHERE place = 1) AS group_a, max(supply) FILTER (WHERE place = 2) AS group_b, max(n) FILTER (WHERE place = 1) AS n_a, "
    "max(n) FILTER (WHERE place = 2) AS n_b, 'ok' AS status FROM g",
    "wilson": f"WITH t AS (SELECT o_orderpriority, count_if(o_totalprice > 400000) AS x, count(*) AS n, {Z95}::DOUBLE AS z FROM orders GROUP BY 1), "
    "p AS (SELECT *, x / n AS p, 1 + z * z / n AS s FROM t), m AS (SELECT *, (p + z * z / (2 * n)) / s AS mid, "
    "z / s * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) AS half FROM p) "
    "SELECT o_orderpriority, x, n, round(p, 10) AS proportion, round(greatest(0, mid - half), 10) AS lo, round(least(1, mid + half), 10) AS hi FROM m",
    "epv_gate": " UNION ALL ".join([
        _gate(_EVENTS, 5, "logistic", f"CASE WHEN {_EVENTS} / 5 < 10 THEN 'refuse' ELSE 'proceed' END", f"CASE WHEN {_EVENTS} / 5 < 10 THEN {_FEW} END",
              f"CASE WHEN {_EVENTS} / 5 < 10 THEN greatest(1, {_EVENTS} // 10) END"),
        _gate(_RARE, 30, "logistic", f"CASE WHEN {_RARE} / 30 < 10 THEN 'refuse' ELSE 'proceed' END", f"CASE WHEN {_RARE} / 30 < 10 THEN {_FEW} END",
              f"CASE WHEN {_RARE} / 30 < 10 THEN greatest(1, {_RARE} // 10) END"),
        _gate("(SELECT count(*) FROM orders)", 3, "linear", "'proceed'", "NULL"),
        _gate(_EVENTS, 2, "survival", "'refuse'", "'repeated measures'"),
    ]),
    "glm_linear": "WITH r AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a, count(*) AS n, "
    "regr_sxx(l_extendedprice, l_quantity) AS sxx, regr_syy(l_extendedprice, l_quantity) AS syy, regr_sxy(l_extendedprice, l_quantity) AS sxy, "
    "avg(l_quantity) AS m FROM lineitem), s AS (SELECT *, sqrt((syy - sxy * sxy / sxx) / (n - 2)) AS e FROM r) "
    "SELECT 'l_quantity' AS term, round(b, 5) AS estimate, round(e / sqrt(sxx), 5) AS se FROM s UNION ALL "
    "SELECT '(intercept)', round(a, 5), round(e * sqrt(1.0::DOUBLE / n + m * m / sxx), 5) FROM s",
}
