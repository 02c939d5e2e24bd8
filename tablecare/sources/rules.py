"""Vocabularies and definitions kept as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import match_name, name_key
from ..functions.rules import parse_rule, term_key_expr
from ..functions.text import is_blank, quoted, trimmed
from ..operators.cells import row_order, text_of
from ..operators.conditions import Definition

# The header spellings of a definitions table, by preference, and
# how many definitions one plan takes as literals.
TERM_HEADERS = ["term", "name", "meaning", "phrase", "definition of"]
COLUMN_HEADERS = ["columnitappliesto", "column", "appliesto", "field", "incolumn", "columnname"]
RULE_HEADERS = ["valuesthatcount", "values", "counts", "definition", "rule", "meaning", "valuescounted"]
MAX_DEFINITIONS = 2000


def merge_vocabulary(vocab: DataFrame) -> DataFrame:
    """``column, term`` with the lists of one column merged."""
    return vocab.select("column", "term").filter(F.col("term").isNotNull()).dropDuplicates(["column", "term"])


def _pick(columns: list[str], wanted: list[str], position: int) -> str:
    found = next((c for w in wanted for c in columns if name_key(c) == w), None)
    return found or columns[position]


def parse_definitions(df: DataFrame, order_by) -> DataFrame:
    """``key, term, column, rule`` per defined term; the last row of a term wins."""
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    columns = [c for c in df.columns if c not in order]
    term, column, rule = (
        _pick(columns, TERM_HEADERS, 0), _pick(columns, COLUMN_HEADERS, 1), _pick(columns, RULE_HEADERS, 2)
    )
    last = Window.partitionBy("key").orderBy(F.desc("at"))
    rows = df.filter(~is_blank(quoted(term))).select(
        term_key_expr(quoted(term)).alias("key"), trimmed(quoted(term)).alias("term"),
        F.when(~is_blank(quoted(column)), trimmed(quoted(column))).alias("column"),
        parse_rule(text_of(df, rule)).alias("rule"), row_order(order_by).alias("at"),
    )
    return rows.withColumn("rn", F.row_number().over(last)).filter("rn = 1").select("key", "term", "column", "rule")


def merge_definitions(sheet: DataFrame, store: DataFrame) -> DataFrame:
    """Both sets of definitions; the second wins where both name a term."""
    sides = sheet.select("key", F.struct("term", "column", "rule").alias("a")).join(
        store.select("key", F.struct("term", "column", "rule").alias("b")), "key", "full_outer"
    )
    return sides.select("key", F.coalesce("b", "a").alias("d")).select("key", "d.*")


def load_definitions(parsed: DataFrame, columns: list[str], most: int = MAX_DEFINITIONS) -> list[Definition]:
    """Definitions as conditions over the columns of a table.

    They become literals of a plan, so their number is checked first against ``most``;
    a longer list of values belongs in a table joined by ``keep_listed``.
    """
    rows = parsed.orderBy("key").take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} definitions; raise `most`, or join a table of values with keep_listed")
    out = []
    for r in rows:
        rule, guard = r["rule"], None
        if rule["when_column"]:
            guard = (match_name(rule["when_column"], columns) or rule["when_column"], rule["when_value"])
        out.append(Definition(
            r["term"], match_name(r["column"], columns), rule["kind"], rule["op"], rule["value"], guard,
            tuple(rule["values"] or ()),
        ))
    return out
