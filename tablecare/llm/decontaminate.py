"""Benchmark decontamination: Wu-Manber search for benchmark windows in document words.

Texts are lower-cased (A-Z) and cut into words of ASCII letters, digits and all
characters beyond ASCII.  A pattern is a window of 10 consecutive item words, or a
whole shorter item.  Patterns of one length share one matcher over word numbers (the
exact dictionary of the benchmark's words; any other word is 0):

* a shift table over hashed blocks of two words tells how far the scan may jump
  because no pattern ends there (of the block's hash, the least distance to an end);
* where the shift is 0, the hash of the last block selects the patterns of one bucket;
* each is compared directly, word by word.

The scan advances many positions at once: a slice of documents is one array of word
numbers, cut into lanes that jump on their own.  Documents are parted by the unknown
word, which no pattern holds.

The benchmark reaches the tasks by broadcast, in blocks of at most ``BLOCK_BYTES`` of
text; a larger benchmark is split by hash and the documents pass through one search
per block, without a shuffle.

Defined cases: null texts have no words; items without words match nothing; a null item
id counts for hits but is not listed; repeated items and rows are ordinary; empty
tables give no rows (documents) or no hits (benchmark).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, stored

WINDOW = 10
BLOCK_BYTES = 8 << 20
SLICE = 2 << 20
LANE = 256
TABLE_BITS = 18

# Every byte that is no word character becomes a space; A-Z become a-z.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(WORD_BYTES).split() if text else []


class Matcher:
    """Wu-Manber tables for patterns of one length over word numbers."""

    def __init__(self, patterns: np.ndarray):
        self.length = patterns.shape[1]
        self.block = min(2, self.length)
        self.shift = np.full(1 << TABLE_BITS, self.length - self.block + 1, np.int32)
        for end in range(self.block - 1, self.length):
            blocks = self._hash(patterns[:, end - 1] if self.block > 1 else None, patterns[:, end])
            np.minimum.at(self.shift, blocks, self.length - 1 - end)
        suffix = self._hash(patterns[:, -2] if self.block > 1 else None, patterns[:, -1])
        order = np.argsort(suffix, kind="stable")
        self.numbers, self.patterns = order, patterns[order]
        starts = np.searchsorted(suffix[order], np.arange((1 << TABLE_BITS) + 1))
        self.bucket_start, self.bucket_size = starts[:-1], np.diff(starts)

    @staticmethod
    def _hash(before: np.ndarray | None, last: np.ndarray) -> np.ndarray:
        mixed = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if before is not None:
            mixed ^= (before.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def search(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start position, pattern number) of every occurrence."""
        at = np.arange(self.length - 1, len(words), LANE)
        until = np.minimum(at + LANE, len(words))
        ends, buckets = [], []
        while len(at):
            block = self._hash(words[at - 1] if self.block > 1 else None, words[at])
            jump = self.shift[block]
            here = jump == 0
            ends.append(at[here])
            buckets.append(block[here])
            at = at + np.maximum(jump, 1)
            live = at < until
            at, until = at[live], until[live]
        if not ends:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        end, bucket = np.concatenate(ends), np.concatenate(buckets)
        starts, numbers = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        places, nth = np.arange(self.length), 0
        while True:
            more = self.bucket_size[bucket] > nth
            end, bucket = end[more], bucket[more]
            if not len(end):
                return np.concatenate(starts), np.concatenate(numbers)
            entry = self.bucket_start[bucket] + nth
            first = end - self.length + 1
            same = (words[first[:, None] + places] == self.patterns[entry]).all(1)
            starts.append(first[same])
            numbers.append(self.numbers[entry[same]])
            nth += 1


class Benchmark:
    """The windows of one block of items: a dictionary of words and a matcher per window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW):
        self.numbers: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for place, (_, text) in enumerate(items):
            words = np.array([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)], np.int32)
            if len(words):
                by_length.setdefault(min(window, len(words)), []).append((place, words))
        # Per length: the matcher of the distinct windows, and the items of each as one array cut at starts.
        self.matchers: list[tuple[Matcher, np.ndarray, np.ndarray]] = []
        for length, group in by_length.items():
            rows = np.concatenate([sliding_window_view(words, length) for _, words in group])
            owner = np.repeat([place for place, _ in group], [len(words) - length + 1 for _, words in group])
            whole = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.itemsize * length))).ravel()
            _, first, number = np.unique(whole, return_index=True, return_inverse=True)
            order = np.argsort(number, kind="stable")
            starts = np.searchsorted(number[order], np.arange(len(first) + 1))
            self.matchers.append((Matcher(rows[first]), owner[order], starts))

    def search(self, texts: list[list[bytes]]) -> list[tuple[np.ndarray, set[str]]]:
        """Per text: a mark for each hit word, and the items with an occurring window."""
        get = self.numbers.get
        sizes = np.array([len(t) for t in texts], np.int64)
        firsts = np.cumsum(sizes + 1) - sizes - 1
        words = np.zeros(int(sizes.sum()) + len(texts), np.int32)
        for first, text in zip(firsts.tolist(), texts):
            words[first : first + len(text)] = [get(w, 0) for w in text]
        edges = np.zeros(len(words) + 1, np.int64)
        items: list[set[str]] = [set() for _ in texts]
        for matcher, owner, cuts in self.matchers:
            starts, numbers = matcher.search(words)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + matcher.length, -1)
            of_text = np.searchsorted(firsts, starts, side="right") - 1
            for t, n in set(zip(of_text.tolist(), numbers.tolist())):
                items[t].update(self.names[i] for i in owner[cuts[n] : cuts[n + 1]].tolist() if self.names[i] is not None)
        hit = np.cumsum(edges)[:-1] > 0
        return [(hit[f : f + n], s) for f, n, s in zip(firsts.tolist(), sizes.tolist(), items)]


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FOUND = [
    T.StructField("__n_words", T.LongType()), T.StructField("__spans", SPANS),
    T.StructField("__items", T.ArrayType(T.StringType())),
]
ARROW_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _searcher(shared, held: list[str], text_name: str, later: bool):
    """A pass over documents for one block that keeps ``held``; ``later``: findings of earlier blocks come along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = shared.value

        def found(batch: pa.RecordBatch, start: int, texts: list[list[bytes]]) -> pa.RecordBatch:
            part = batch.slice(start, len(texts))
            results = benchmark.search(texts)
            if later:
                for (hit, items), spans, known in zip(results, part.column("__spans").to_pylist(), part.column("__items").to_pylist()):
                    for s in spans:
                        hit[s["start"] : s["end"]] = True
                    items.update(known)
            columns = [
                *[part.column(n) for n in held],

                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in spans_of(hit)] if hit.any() else [] for hit, _ in results], ARROW_SPANS),
                pa.array([sorted(items) for _, items in results], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(columns, names=[*held, *[f.name for f in FOUND]])

        for batch in batches:
            start, waiting, size = 0, [], 0
            for text in (x.as_py() for x in batch.column(text_name)):
                waiting.append(words_of(text))
                size += len(text or "")
                if size > SLICE:
                    yield found(batch, start, waiting)
                    start, waiting, size = start + len(waiting), [], 0
            if waiting:
                yield found(batch, start, waiting)

    return run


def blocks_of(benchmark: DataFrame, item: str, text: str, block_bytes: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple]]]:
    """How many blocks of about ``block_bytes`` of text the items make, and these, each collected when it is asked for."""
    rows = benchmark.select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).head()[0]
    blocks = max(1, -(-total // block_bytes))
    parts = (rows.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) for b in range(blocks))
    return blocks, ([(r["item"], r["text"]) for r in part.collect()] for part in parts)


def find_windows(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``keep`` of ``docs``, then ``n_words``, ``spans`` of hit words and the ``items`` found.

    Spans count words from 0 and their ends are exclusive; items are sorted strings.
    """
    keep = list(docs.columns) if keep is None else keep
    sc = docs.sparkSession.sparkContext
    names = [f"__kept{i}" for i in range(len(keep))]
    out, at_text = carried(docs, keep, text)
    text_name = out.columns[at_text]
    blocks, parts = blocks_of(benchmark, item, item_text, block_bytes)
    for i, items in enumerate(parts):
        shared, last = sc.broadcast(Benchmark(items, window)), i + 1 == blocks
        held = names if text_name in names or last else [*names, text_name]
        fields = [out.schema[n] for n in held]
        out = out.mapInArrow(_searcher(shared, held, text_name, i > 0), T.StructType([*fields, *FOUND]))
        if not last:
            # The findings so far are stored, so one block at a time is in memory.
            out = stored(out)
            shared.destroy()
    added = ("n_words", "spans", "items")
    return out.select(
        *[F.col(n).alias(c) for n, c in zip(names, keep) if c not in added],
        F.col("__n_words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"),
    )


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
