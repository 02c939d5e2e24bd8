"""Stable codes for names: assign, apply, save and load.

The code table is the only link from a code to a person; it is written as its
own table and never handed to the report cards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import quoted, trimmed
from ..operators.cells import blank_of, row_order
from ..operators.joins import replace_by_codes
from ..operators.numbering import number_rows

SCHEMA = "name string, code string, seq long"


@dataclass(frozen=True)
class Coded:
    """Rows with codes, the code table after, and the names that were new."""

    rows: DataFrame
    codes: DataFrame
    new: DataFrame


def empty_codes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def assign_codes(df: DataFrame, column: str, order_by, codes: DataFrame, prefix: str = "Person") -> DataFrame:
    """Codes for names that have none, numbered in order of first appearance.

    Names are made distinct first, and only the new ones are put in order; that
    order is computed over all partitions.
    """
    names = df.filter(~blank_of(df, column)).select(
        trimmed(quoted(column)).alias("name"), row_order(order_by).alias("first")
    ).groupBy("name").agg(F.min("first").alias("first"))
    new = names.join(codes.select("name"), "name", "left_anti")
    used = codes.agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
    numbered = number_rows(new, [F.asc("first"), F.asc("name")], "place").withColumn("seq", F.col("place") + used)
    digits = F.when(F.col("seq") < 10, F.concat(F.lit("0"), F.col("seq").cast("string"))).otherwise(
        F.col("seq").cast("string")
    )
    return numbered.select("name", F.concat(F.lit(prefix.strip() + " "), digits).alias("code"), "seq")


def deidentify(df: DataFrame, column: str, order_by, codes: DataFrame | None = None, prefix: str = "Person") -> Coded:
    """Replace the names in a column by codes that stay the same in later runs."""
    codes = codes if codes is not None else empty_codes(df.sparkSession)
    new = assign_codes(df, column, order_by, codes, prefix)
    every = codes.select("name", "code", "seq").unionByName(new)
    return Coded(replace_by_codes(df, column, every), every, new)


def save_codes(codes: DataFrame, path: str) -> None:
    """Write the code table to a new folder; an existing one is never overwritten."""
    codes.write.mode("errorifexists").parquet(path)


def load_codes(spark: SparkSession, path: str) -> DataFrame:
    """A saved code table, checked for its columns and for doubled names or codes."""
    codes = spark.read.parquet(path)
    if not {"name", "code", "seq"} <= set(codes.columns):
        raise ValueError("this is no code table: it needs name, code and seq")
    facts = codes.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("name").alias("names"), F.count_distinct("code").alias("codes")
    ).first()
    if not facts["n"] == facts["names"] == facts["codes"]:
        raise ValueError("this code table names a person or a code twice")
    return codes.select("name", "code", "seq")
