"""What the operators of this package share: stored tables, sorted places, safe names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import checkpoint_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it from there.

    Every later read sees the same rows, also after an executor is lost, and reads
    only the columns it needs.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(df: DataFrame, order_by: list[Column]) -> DataFrame:
    """``df`` sorted over all partitions and stored, each row with partition and place in it."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(df.orderBy(*order_by).select("*", F.spark_partition_id().alias("__part"), inside.alias("__pos")))


def numbered(df: DataFrame, order_by: list[Column], name: str) -> DataFrame:
    """Add ``name`` = 0, 1, 2, ... in the order of ``order_by``; no task sees all rows.

    Rows keep their place inside a sorted partition, shifted by the sizes of the
    partitions before it.  The shifts are one row per partition.
    """
    rows = placed(df, order_by)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    shifts = shifts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    return rows.join(F.broadcast(shifts), "__part").select(*df.columns, (F.col("__pos") + F.col("__shift")).alias(name))


def joined_spread(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """``left`` joined with the one row per key of ``right``, where ``n`` says how many rows of ``left`` have the key.

    Keys of at least a 100,000th of the ``total`` rows (and 1,000) are at most 100,000 and
    go to every task; the others meet by shuffle, where none is large.
    """
    large = F.col(n) >= max(1000, total // 100_000)
    marked = left.join(F.broadcast(right.filter(large).drop(n).withColumn("__large", F.lit(True))), key, "left")
    rest = marked.filter(F.col("__large").isNull()).select(*left.columns).join(right.filter(~large).drop(n), key)
    return marked.filter("__large").drop("__large").unionByName(rest)


def carried(df: DataFrame, keep: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns ``keep`` under safe names (``__kept0`` ...), and the place of the text column.

    The text is added only where it is not among ``keep``, so no row holds it twice.
    """
    kept = [F.col(f"`{c}`").alias(f"__kept{i}") for i, c in enumerate(keep)]
    if text in keep and df.schema[text].dataType == T.StringType():
        return df.select(*kept), keep.index(text)
    return df.select(*kept, F.col(f"`{text}`").cast("string").alias("__text")), len(keep)


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text).cast("long"), F.lit(0).cast("long"))
