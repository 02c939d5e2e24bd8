"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are integers: each component x becomes floor(scale * x).  The index holds, per
block of up to ``BLOCK`` vectors, posting segments: all (dimension, vector, impact)
whose impact has the same quantised size (the number of bits of its magnitude), largest
first.  A search adds the segments of a block to the scores of all queries in that
order.  After each segment, what a vector may still gain is at most the product of the
query's norm and the norm of the vector's unread impacts; a block is left as soon as
these bounds prove that few vectors can be among the best, and those possible members
are scored exactly.  The k-th best scores found so far in the task carry over to its
next blocks, so later blocks stop sooner.

Queries are a stated set; they go to the tasks in batches of at most ``QUERIES``
vectors, each batch meets every block once and its result is stored.  Per task and query only k + 1 rows
leave; the last ranking is a window per query over these.

Defined cases: vectors that are null or hold null, NaN or infinite components take no
part; a shorter vector counts as zero beyond its end (an empty one scores 0); equal
scores rank by smaller id, null ids last; rows that repeat an id are rows of their own,
and a query skips one row of its own id and vector, its own; empty tables give empty
results.  Scores must fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BLOCK = 4096
QUERIES = 2048
#: Possible members per query beside which further segments are not worth reading.
FEW = 64
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min

INDEX = "ids binary, width int, segments array<struct<dimensions:binary,vectors:binary,impacts:binary>>"


def usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def integers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def rows_of(column: pa.Array) -> list[np.ndarray]:
    values, offsets = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    base = offsets[0]
    return [values[a - base : b - base] for a, b in zip(offsets, offsets[1:])]


def matrix(vectors: list[np.ndarray], width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(width, len(v))] = v[:width]
    return out


def build_index(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """One row per block of vectors with its posting segments, largest impacts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                rows = rows_of(batch.column(1))
                width = max(map(len, rows))
                x = matrix(rows, width)
                ids = np.array([NO_ID if v is None else v for v in batch.column(0).to_pylist()], np.int64)
                vectors_at, dimensions = np.nonzero(x)
                impacts = x[vectors_at, dimensions]
                bits = np.frexp(np.abs(impacts).astype(np.float64))[1]
                segments = []
                for level in sorted(set(bits.tolist()), reverse=True):
                    here = bits == level
                    segments.append({
                        "dimensions": dimensions[here].astype("<i4").tobytes(), "vectors": vectors_at[here].astype("<i4").tobytes(),
                        "impacts": impacts[here].astype("<i8").tobytes(),
                    })
                kind = pa.list_(pa.struct([("dimensions", pa.binary()), ("vectors", pa.binary()), ("impacts", pa.binary())]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([segments], kind)],
                    names=["ids", "width", "segments"],
                )

    taken = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector"))
    return taken.filter(usable(F.col("vector"))).select("id", integers(F.col("vector"), scale).alias("vector")).mapInArrow(run, INDEX)


def possible_members(segments: list[tuple], n: int, queries: np.ndarray, known: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, vectors): a proven superset, per query, of the block's vectors in the best k, and the vectors.

    ``known`` is a score per query that k vectors elsewhere already reach.
    """
    width = queries.shape[1]
    vectors = np.zeros((n, width), np.int64)
    for dimensions, places, impacts in segments:
        vectors[places, dimensions] = impacts
    unread = (vectors.astype(np.float64) ** 2).sum(1)
    norms = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    weights = queries.astype(np.float64)
    scores = np.zeros((len(queries), n))
    least = known.astype(np.float64)
    members = np.ones((len(queries), n), bool)
    for dimensions, places, impacts in segments:
        part = np.zeros((n, width))
        part[places, dimensions] = impacts
        scores += weights @ part.T
        np.subtract.at(unread, places, impacts.astype(np.float64) ** 2)
        # Rounding of the sums stays far below one part in 10^9 of the norms' product.
        whole = norms[:, None] * np.sqrt((vectors.astype(np.float64) ** 2).sum(1))[None, :]
        gain = norms[:, None] * np.sqrt(np.maximum(unread, 0))[None, :] + whole * 1e-9
        if n > k:
            reached = scores - gain
            least = np.maximum(least, np.partition(reached, n - k, axis=1)[:, n - k])
        members = scores + gain >= least[:, None]
        if members.sum(1).max() <= FEW:
            break
    return members, vectors


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    largest = int(np.abs(vectors).max(initial=0)) * int(np.abs(query).max(initial=0)) * max(1, len(query))
    if largest < 1 << 62:
        return vectors @ query
    return np.array([sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors], np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def search(index: DataFrame, queries: list[tuple[int, np.ndarray]], k: int) -> DataFrame:
    """(query, id, score): the best k of every task for each query; ``queries`` has (number, vector)."""
    numbers = np.array([n for n, _ in queries], np.int64)
    width = max([len(v) for _, v in queries], default=0)
    shared = index.sparkSession.sparkContext.broadcast((numbers, matrix([v for _, v in queries], width)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, wanted = shared.value
        found = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(numbers)
        known = np.full(len(numbers), LOWEST, np.int64)
        for batch in batches:
            for ids, width, segments in zip(*(batch.column(c) for c in ("ids", "width", "segments"))):
                ids, width = np.frombuffer(ids.as_py(), np.int64), max(width.as_py(), wanted.shape[1])
                read = [
                    (np.frombuffer(s["dimensions"], "<i4"), np.frombuffer(s["vectors"], "<i4"), np.frombuffer(s["impacts"], "<i8"))
                    for s in segments.as_py()
                ]
                weights = np.zeros((len(wanted), width), np.int64)
                weights[:, : wanted.shape[1]] = wanted
                for at in range(0, len(weights), 512):
                    some = slice(at, at + 512)
                    members, vectors = possible_members(read, len(ids), weights[some], known[some], k)
                    for q in range(len(members)):
                        places = np.flatnonzero(members[q])
                        if not len(places):
                            continue
                        had_ids, had_scores = found[at + q]
                        got = exact_scores(vectors[places], weights[at + q])
                        found[at + q] = best(np.concatenate([had_ids, ids[places]]), np.concatenate([had_scores, got]), k)
                        if len(found[at + q][1]) == k:
                            known[at + q] = found[at + q][1][-1]
        sizes = [len(i) for i, _ in found]
        if sum(sizes):
            ids = np.concatenate([i for i, _ in found])
            yield pa.RecordBatch.from_arrays([
                pa.array(np.repeat(numbers, sizes)), pa.array(ids, mask=ids == NO_ID),
                pa.array(np.concatenate([s for _, s in found])),
            ], names=["query", "id", "score"])

    return index.mapInArrow(run, "query long, id long, score long")


def top_k(
    vectors: DataFrame, asked: Column, k: int, id_column: str = "vec_id", vector: str = "embedding", scale: int = 256,
) -> DataFrame:
    """(query_id, rank, id, score): the k best other rows for each row where ``asked`` is true."""
    index = stored(build_index(vectors, id_column, vector, scale))
    chosen = vectors.filter(asked & usable(F.col(f"`{vector}`"))).select(
        F.col(f"`{id_column}`").cast("long").alias("query_id"), integers(F.col(f"`{vector}`"), scale).alias("vector")
    )
    chosen = stored(chosen.select("*", F.monotonically_increasing_id().alias("query")))
    own = F.aggregate("vector", F.lit(0).cast("long"), lambda s, x: s + x * x)
    parts, waiting = [], []
    for row in chosen.select("query", "vector").toLocalIterator():
        waiting.append((row["query"], np.array(row["vector"], np.int64)))
        if len(waiting) == QUERIES:
            parts.append(stored(search(index, waiting, k + 1)))
            waiting = []
    if waiting or not parts:
        parts.append(search(index, waiting, k + 1))
    met = reduce(DataFrame.unionByName, parts).join(chosen.select("query", "query_id", own.alias("own")), "query")
    order = [F.col("score").desc(), F.col("id").asc_nulls_last()]
    per_query = Window.partitionBy("query")
    ranked = met.withColumn("at", F.row_number().over(per_query.orderBy(*order))).filter(F.col("at") <= k + 1)
    itself = F.col("id").eqNullSafe(F.col("query_id")) & (F.col("score") == F.col("own"))
    skipped = F.min(F.when(itself, F.col("at"))).over(per_query)
    others = ranked.withColumn("skip", skipped).filter(F.col("skip").isNull() | (F.col("at") != F.col("skip")))
    rank = F.col("at") - F.when(F.col("skip") < F.col("at"), 1).otherwise(0)
    return others.select("query_id", rank.cast("int").alias("rank"), "id", "score").filter(F.col("rank") <= k)
