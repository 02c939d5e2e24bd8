"""Delimited text in and out, without guessing types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import unique_names
from ..functions.numbers import number_text
from ..functions.text import quoted, trimmed
from ..operators.cells import is_temporal, is_text, text_of

ROW = "_row"


def read_delimited(
    spark: SparkSession, path: str | list[str], sep: str | None = None, multiline: bool = False
) -> DataFrame:
    """CSV or TSV with every cell as literal text.

    Only header lines are read here.  Every file must have the first file's header;
    Spark checks that as it reads, and refuses a file with other columns or another
    order.  Where header names are blank or repeat, they are compared first, file by
    file, and must be equal.  ``_row`` sorts in file order however
    Spark packs the splits.  ``multiline`` allows line breaks inside quoted
    cells, at the price of one task per file.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if sep is None:
        sep = "\t" if paths[0].lower().endswith((".tsv", ".tab")) else ","
    reader = spark.read.option("sep", sep).option("multiLine", multiline).option("inferSchema", False)
    head = reader.csv(paths).head()
    if head is None:
        raise ValueError("no data found: the first line must hold the column headers")
    written, names = list(head), unique_names(list(head))
    plain = all(written) and len({n.lower() for n in written}) == len(written)
    if not plain:
        for file in reader.csv(paths).inputFiles():
            if list(reader.csv(file).head() or []) != written:
                raise ValueError(f"the header of {file} differs from the first file's")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (written if plain else names)])
    rows = reader.schema(schema).option("header", True).option("enforceSchema", not plain).csv(paths)
    cells = [quoted(f.name).alias(n) for f, n in zip(schema, names)]
    return _numbered(rows.select(
        *cells, F.input_file_name().alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    ), names, sorted(reader.csv(paths).inputFiles()))


def _numbered(rows: DataFrame, names: list[str], files: list[str]) -> DataFrame:
    """``_row`` as one number: the file's place, then the split's, then the row's in its task.

    A number, unlike a struct, is aggregated by hashing.
    """
    listed = rows.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "__file string, __place long")
    if len(files) == 1:
        placed = rows.withColumn("__place", F.lit(0))
    else:
        placed = rows.join(listed, "__file", "left")
    number = lambda c, digits: F.col(c).cast(f"decimal({digits},0)")
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)).cast("decimal(10,0)")
    row = number("__place", 10) * F.lit(str(1 << 77)).cast("decimal(24,0)") + number("__block", 14) * F.lit(1 << 33).cast("decimal(10,0)") + inside
    return placed.select(*[quoted(n) for n in names], row.cast("decimal(38,0)").alias(ROW))


def normalise(df: DataFrame, numeric_text: bool = True, keep: tuple[str, ...] = (ROW,)) -> DataFrame:
    """Trim, empty to null, dates to ISO text, clean numeric text to a number (S3)."""
    def cell(name: str):
        if name in keep:
            return quoted(name)
        if is_text(df, name):
            t = trimmed(quoted(name))
            return F.when(t != "", number_text(t) if numeric_text else t).alias(name)
        return (text_of(df, name) if is_temporal(df, name) else quoted(name)).alias(name)

    return df.select(*[cell(c) for c in df.columns])


def drop_blank_rows(df: DataFrame, keep: tuple[str, ...] = (ROW,)) -> DataFrame:
    """Leave out rows whose every cell is null."""
    return df.dropna("all", subset=[c for c in df.columns if c not in keep])


def blank_row_count(df: DataFrame, keep: tuple[str, ...] = (ROW,)) -> DataFrame:
    """How many rows ``drop_blank_rows`` leaves out, counted by an aggregate of its own."""
    filled = F.coalesce(*[quoted(c).cast("string") for c in df.columns if c not in keep])
    return df.agg(F.count_if(filled.isNull()).alias("dropped"))


def load_text(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Read, normalise and drop blank rows."""
    return drop_blank_rows(normalise(read_delimited(spark, path, **options)))


def load_tables(spark: SparkSession, paths: dict[str, str], **options) -> dict[str, DataFrame]:
    """Several named tables in one load."""
    return {name: load_text(spark, path, **options) for name, path in paths.items()}


def write_delimited(df: DataFrame, path: str) -> None:
    """All rows with a header, one part file per task."""
    plain = [quoted(c) for c in df.columns if c != ROW and not isinstance(df.schema[c].dataType, T.StructType)]
    df.select(*plain).write.mode("overwrite").option("header", True).csv(path)
