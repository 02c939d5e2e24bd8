"""Line dedup by overlapping three-line windows, repeated anywhere in the corpus.

A text is cut at line feeds.  Its lines that hold more than white space are counted
from 0, compared without white space at their ends, and every three consecutive ones
form a window.  A window is known by a 128-bit hash.  Of all places where a window
occurs, the first (by key, then text digest, then place in the text) stays; every later
place covers its three lines, overlapping covers merge, and covered lines go.  Blank
lines stay.  Texts of fewer than three such lines have no window and stay whole.

Only hashes and places are shuffled to find windows: the first place and the number of
places of a window combine in every task.  Places of the most common windows, of which there
are at most 100,000, are compared with the first one where they stand; the others meet it
by shuffle, so a passage of a third of all texts is no one task's.  Texts move once, to
meet the covers of their key.

Rows equal in key and text are one document given the same result; a null key sorts
first and is joined like a value; null texts stay null with no lines; empty tables give
empty results.  A column named like a result column is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_128_digest

from .common import joined_spread, stored

WINDOW = 3
SEPARATOR = b"\n"


def counted_lines(lines: list[str]) -> list[int]:
    """The places of the lines that hold more than white space."""
    return [i for i, line in enumerate(lines) if line.strip()]


def window_hashes(text: str | None, window: int = WINDOW) -> list[bytes]:
    lines = [x.strip().encode("utf-8", "replace") for x in text.split("\n")] if text else []
    lines = [x for x in lines if x]
    return [xxh3_128_digest(SEPARATOR.join(lines[i : i + window])) for i in range(len(lines) - window + 1)]


def without(text: str, starts: list[int], window: int = WINDOW) -> tuple[str, list[tuple[int, int]]]:
    """The text less the windows that start at the given counted lines, and the removed line spans."""
    lines = text.split("\n")
    counted = counted_lines(lines)
    gone = {counted[j] for s in starts for j in range(s, s + window)}
    spans: list[tuple[int, int]] = []
    for i in sorted(gone):
        if spans and spans[-1][1] == i:
            spans[-1] = (spans[-1][0], i + 1)
        else:
            spans.append((i, i + 1))
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), spans


def windows_of(docs: DataFrame, key: str, text: str, window: int = WINDOW) -> DataFrame:
    """(key, digest, place, hash) of every window; ``digest`` tells texts of one key apart."""
    taken = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([
        taken.schema["key"], T.StructField("digest", T.LongType()), T.StructField("place", T.LongType()),
        T.StructField("hash", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes = [], [], []
            for i, value in enumerate(batch.column("text")):
                found = window_hashes(value.as_py(), window)
                rows += [i] * len(found)
                places += range(len(found))
                hashes += found
            at = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").take(at), batch.column("digest").take(at), pa.array(places, pa.int64()), pa.array(hashes, pa.binary())],
                names=schema.names,
            )

    return taken.withColumn("digest", F.xxhash64("text")).select("key", "digest", "text").mapInArrow(run, schema)


def later_places(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, digest, starts): the windows of each text that occurred before, by their first counted line."""
    windows = stored(windows_of(docs, key, text, window).distinct())
    place = F.struct("key", "digest", "place")
    repeated = stored(windows.groupBy("hash").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    later = joined_spread(windows, repeated, "hash", "n", windows.count()).filter(~place.eqNullSafe(F.col("first")))
    return later.groupBy("key", "digest").agg(F.sort_array(F.collect_list("place")).alias("starts"))


def drop_repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with its text less the repeated windows, ``n_lines``, ``n_removed`` and ``removed`` line spans."""
    added = ("n_lines", "n_removed", "removed")
    kept = [c for c in docs.columns if c not in added]
    fields = [docs.schema[c] for c in kept]
    covers = later_places(docs, key, text, window).select(F.col("key").alias("__key"), F.col("digest").alias("__digest"), "starts")
    whole = docs.select(*[F.col(f"`{c}`").alias(f"__kept{i}") for i, c in enumerate(kept)])
    at_key, at_text = kept.index(key), kept.index(text)
    joined = whole.join(
        covers,
        F.col(f"__kept{at_key}").eqNullSafe(F.col("__key")) & (F.xxhash64(f"__kept{at_text}") == F.col("__digest")), "left",
    ).drop("__key", "__digest")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([
        *[T.StructField(f"__kept{i}", f.dataType) for i, f in enumerate(fields)],
        T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", spans),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lines, removed = [], [], []
            for value, starts in zip(batch.column(at_text), batch.column("starts")):
                said = value.as_py()
                left, gone = without(said, starts.as_py(), window) if starts.is_valid else (said, [])
                texts.append(left)
                lines.append(0 if said is None else said.count("\n") + 1)
                removed.append(gone)
            columns = list(batch.columns[: len(kept)])
            columns[at_text] = pa.array(texts, columns[at_text].type)
            columns += [
                pa.array(lines, pa.int64()), pa.array([sum(b - a for a, b in r) for r in removed], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in r] for r in removed], pa.list_(span)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.mapInArrow(run, schema).select(*[F.col(f"__kept{i}").alias(c) for i, c in enumerate(kept)], *added)
