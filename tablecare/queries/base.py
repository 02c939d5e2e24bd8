"""Shared inputs: the driver tables and the messy columns derived from them.

The driver tables are clean and typed, so the messy tables are derived row by
row from their keys.  One SELECT text serves both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ISO = (
    "CAST(year({c}) AS STRING) || '-' || lpad(CAST(month({c}) AS STRING), 2, '0') || '-' || "
    "lpad(CAST(day({c}) AS STRING), 2, '0')"
)
SLASH = "CAST(day({c}) AS STRING) || '/' || CAST(month({c}) AS STRING) || '/' || CAST(year({c}) AS STRING)"

MESSY_ORDERS = f"""
SELECT o_orderkey AS row_id,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL WHEN o_orderkey % 17 = 0 THEN '  '
       WHEN o_orderkey % 5 = 0 THEN ' c' || CAST(o_custkey AS STRING)
       ELSE 'C' || CAST(o_custkey AS STRING) || ' ' END AS patient_id,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN ' ' WHEN o_orderkey % 11 = 2 THEN 'N/A'
       WHEN o_orderkey % 11 = 3 THEN upper(o_orderpriority) || '  ' WHEN o_orderkey % 11 = 4 THEN lower(o_orderpriority)
       ELSE o_orderpriority END AS priority,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN '2-HIGH' ELSE '3-Medium ' END AS second_priority,
  o_orderstatus AS status,
  CASE WHEN o_orderkey % 8 = 0 THEN 'N/A' WHEN o_orderkey % 8 = 1 THEN '$' || CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING)
       WHEN o_orderkey % 8 = 2 THEN '<0.5' WHEN o_orderkey % 8 = 3 THEN ' 1,204 '
       WHEN o_orderkey % 8 = 4 THEN CAST(o_orderkey % 40 AS STRING) || ' mg' WHEN o_orderkey % 8 = 5 THEN '12-14'
       WHEN o_orderkey % 88 = 6 THEN NULL
       ELSE CAST(CAST(floor(o_totalprice / 1000) AS BIGINT) AS STRING) END AS amount,
  CASE WHEN o_orderkey % 6 = 0 THEN {SLASH.format(c='o_orderdate')} WHEN o_orderkey % 6 = 1 THEN 'N/A'
       WHEN o_orderkey % 12 = 2 THEN NULL ELSE {ISO.format(c='o_orderdate')} END AS visit_date,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 'red, blue' WHEN o_orderkey % 10 = 2 THEN 'red; blue ;green'
       WHEN o_orderkey % 10 = 3 THEN ' , ' ELSE 'blue' END AS tags,
  CASE WHEN o_orderkey % 10 = 1 THEN '500, 250' WHEN o_orderkey % 10 = 2 THEN '500, 250' ELSE '100' END AS doses,
  CASE WHEN o_orderkey % 5 = 0 THEN '1900-01-' || lpad(CAST(1 + o_orderkey % 28 AS STRING), 2, '0')
       ELSE CAST(o_orderkey % 30 AS STRING) END AS stay,
  CASE WHEN o_orderkey % 4 = 0 THEN 'N/A' ELSE CAST(o_orderkey % 12 AS STRING) || ' Days' END AS course_days
FROM @orders"""

# Three copies of every order, told apart only by row_id; some copies differ in a note.
COPIED_VISITS = """
SELECT o_orderkey * 10 + copy AS row_id,
  CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey END AS visit_id,
  o_custkey AS customer, o_orderpriority AS priority,
  CASE WHEN o_orderkey % 5 = 0 THEN CAST(copy AS STRING) ELSE 'same' END AS note
FROM (SELECT *, 0 AS copy FROM @orders UNION ALL SELECT *, 1 AS copy FROM @orders UNION ALL SELECT *, 2 AS copy FROM @orders) AS copies"""

MESSY_CUSTOMER = """
SELECT c_custkey AS row_id,
  CASE WHEN c_custkey % 10 = 0 THEN lower(c_mktsegment) WHEN c_custkey % 10 = 1 THEN ' ' || c_mktsegment
       WHEN c_custkey % 10 = 2 THEN c_mktsegment || 'X' WHEN c_custkey % 10 = 3 THEN NULL ELSE c_mktsegment END AS segment,
  CASE WHEN c_custkey % 7 = 0 THEN 'Nowhere' ELSE 'Nation ' || CAST(c_nationkey AS STRING) END AS nation,
  CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'Dr ' || CAST(c_custkey % 97 AS STRING) || CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE '' END END AS doctor,
  c_acctbal AS balance, c_nationkey
FROM @customer"""

TABLES = {
    "messy_orders": (MESSY_ORDERS, "orders"), "copied_visits": (COPIED_VISITS, "orders"),
    "messy_customer": (MESSY_CUSTOMER, "customer"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def derived(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A messy table, made by Spark from a driver table."""
    sql, source = TABLES[name]
    return spark.sql(sql.replace(f"@{source}", "{" + source + "}"), **{source: table(spark, folder, source)})


def with_tables(sql: str, *names: str) -> str:
    """An oracle query over the derived tables it names."""
    views = ", ".join(f"{n} AS ({TABLES[n][0].replace('@', '')})" for n in names)
    return f"WITH {views} {sql}"


# --- the cell rules in SQL ----------------------------------------------------------


def trim(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def fold(c: str) -> str:
    return f"regexp_replace(lower({trim(c)}), '\\s+', ' ', 'g')"


def blank(c: str) -> str:
    return f"({c} IS NULL OR {trim(c)} = '')"


def missing(c: str) -> str:
    return f"({c} IS NULL OR lower({trim(c)}) IN ('', 'n/a', 'na', 'none', '-', '.'))"


def num(c: str) -> str:
    unit = f"regexp_extract({trim(c)}, '^(-?\\d+(\\.\\d+)?)\\s*[A-Za-z]+\\.?$', 1)"
    clean = f"regexp_replace({c}, '[$,\\s]', '', 'g')"
    return (
        f"(CASE WHEN {unit} <> '' THEN TRY_CAST({unit} AS DOUBLE) "
        f"WHEN regexp_matches({clean}, '^-?\\d+(\\.\\d+)?$') THEN TRY_CAST({clean} AS DOUBLE) END)"
    )


def pct(n: str, total: str) -> str:
    return f"coalesce(floor({n} * 1.0::DOUBLE / nullif({total}, 0) * 1000 + 0.5) / 10, 0.0)"


def r2(x: str) -> str:
    return f"(floor(({x}) * 100 + 0.5) / 100)"


def plain(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END)"


def bigint_counts(sql: str) -> str:
    """``count_if(x)`` as a filtered count: the same number, but typed BIGINT."""
    out, rest = "", sql
    while "count_if(" in rest:
        head, rest = rest.split("count_if(", 1)
        depth, end = 1, 0
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        out, rest = out + head + "count(*) FILTER (WHERE " + bigint_counts(rest[: end - 1]) + ")", rest[end:]
    return out + rest
