"""SimHash near-duplicate groups by multi-index hashing.

Texts are lower-cased (A-Z) and split at ASCII white space; every run of ``SHINGLE``
words, repeats included, is hashed (XXH64, seed 42), and a bit of the 64-bit
fingerprint is 1 when it is set in more than half the hashes.  Documents link when
their fingerprints differ in at most ``DISTANCE`` bits; groups are what links connect.

Multi-index hashing: the fingerprint is cut into ``BLOCKS`` = 6 blocks, and every three
blocks together are a segment of about 32 bits with a table of its own.  Of 4 differing
bits, either three blocks have none, and the segments of all 20 triples are looked up as
they are; or exactly two blocks have none and the others one each.  For the second case
every two blocks choose a third, and the Hamming ball of radius 1 in that block is
looked up in their triple's table.  One of two fingerprints has a 0 where they differ,
so a ball only turns 0 into 1.  The whole distance is verified for whatever is met.
Keys of 32 bits keep chance meetings rare up to some 10^10 fingerprints.

No group is compared with itself by pairs:

* equal fingerprints are one row from the start;
* before the search, fingerprints are sorted by four bit rotations and linked to their
  next neighbours where these are within the distance, which joins most of a group of
  near copies with few links;
* the search meets tables only in buckets that hold several groups, and there members
  of the largest group only meet those of the others, so a bucket costs its members times
  the members outside its largest group; what is left is linked exactly.

Two large groups that share buckets but no link are compared member by member.

Groups come from alternating star contractions over the links, stored between rounds
in the shared checkpoint folder.

Defined cases: null and empty texts have fingerprint 0 and link like any other; equal
rows stay equal rows; a null id never names a group unless the group has no other id;
empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from .common import joined_spread, stored
from .components import connected

SHINGLE = 4
DISTANCE = 4
BLOCKS = 6
SEED = 42
CHUNK = 1 << 16


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of all shingles of a whole text, repeats included."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    return np.fromiter(
        map(xxh64_intdigest, [joined[a:b] for a, b in zip(starts, ends)], repeat(SEED)), np.uint64, len(starts)
    )


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole text, as a signed number; 0 of a text without words."""
    hashes = shingle_hashes(text, shingle)
    return majority(hashes) if len(hashes) else 0


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in more than half the hashes, as a signed number."""
    set_in = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * set_in > len(hashes)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", name: str = "fp") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the fingerprint of each text as a long named ``name``."""
    kept = [F.col(f"`{c}`").alias(f"__kept{i}") for i, c in enumerate(keep)]
    taken = docs.select(*kept, F.col(f"`{text}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([fingerprint(x.as_py()) for x in batch.column(len(keep))], pa.int64())
            names = [*batch.schema.names[: len(keep)], "__fp"]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], found], names=names)

    done = taken.mapInArrow(run, T.StructType([*taken.schema.fields[: len(keep)], T.StructField("__fp", T.LongType())]))
    return done.select(*[F.col(f"__kept{i}").alias(c) for i, c in enumerate(keep)], F.col("__fp").alias(name))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


# --- links --------------------------------------------------------------------------


def _signed(x: int) -> int:
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int = BLOCKS) -> list[int]:
    """The 64 bits cut into nearly equal blocks."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]


def segments(limit: int = DISTANCE, blocks: int = BLOCKS) -> tuple[list[int], list[tuple[int, int]]]:
    """The masks of all segments, and the lookups (segment number, flipped bit or 0) that find every close pair.

    A segment is ``blocks - limit + 1`` blocks.  Either that many blocks are equal, or
    just one fewer are and each other block differs in one bit.
    """
    masks, size = block_masks(blocks), blocks - limit + 1
    chosen = list(combinations(range(blocks), size))
    lookups = [(i, 0) for i in range(len(chosen))]
    for equal in combinations(range(blocks), size - 1):
        third = next(b for b in range(blocks) if b not in equal)
        number = chosen.index(tuple(sorted([*equal, third])))
        lookups += [(number, 1 << bit) for bit in range(64) if masks[third] >> bit & 1]
    return [sum(masks[b] for b in c) for c in chosen], lookups


def sorted_links(fps: DataFrame, limit: int = DISTANCE, rotations: int = 4, ahead: int = 2) -> DataFrame:
    """Links (a, b) between fingerprints that are close in one of the rotated sort orders.

    Only a head start: pairs that no order brings together are left to the search.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = np.empty(0, np.int64)
        for batch in batches:
            fp = np.concatenate([before, batch.column(0).to_numpy(zero_copy_only=False)])
            for step in range(1, ahead + 1):
                a, b = fp[:-step], fp[step:]
                new = np.arange(len(a)) + step >= len(before)
                apart = np.unpackbits((a ^ b).view(np.uint8).reshape(-1, 8), axis=1).sum(1)
                near = new & (apart <= limit) & (a != b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(a, b)[near]), pa.array(np.maximum(a, b)[near])], names=["a", "b"]
                )
            before = fp[-ahead:]

    out = None
    for r in range(rotations):
        turn = 64 * r // rotations
        rotated = F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn)) if turn else F.col("fp")
        ordered = fps.select("fp", rotated.alias("__turned")).orderBy("__turned").select("fp")
        links = ordered.mapInArrow(run, "a long, b long")
        out = links if out is None else out.unionByName(links)
    return out.distinct()


def compared(classes: DataFrame, limit: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """The pairs (a, a_root, b, b_root) that meet in a bucket; ``classes`` has (fp, root).

    Spark sizes an exploded table as if each row had stayed one, so these joins are told to sort:
    their 20 to 100 rows a fingerprint would be sent to every task by way of the driver.
    """
    masks, asked = segments(limit, blocks)
    tables = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(_signed(m)).alias("mask")) for i, m in enumerate(masks)])
    probes = F.array(*[
        F.struct(F.lit(i).alias("seg"), F.lit(_signed(masks[i])).alias("mask"), F.lit(_signed(flip)).alias("flip")) for i, flip in asked
    ])
    members = classes.select(F.col("fp").alias("b"), F.col("root").alias("b_root"), F.explode(tables).alias("t"))
    members = members.select("b", "b_root", F.col("t.seg").alias("seg"), F.col("b").bitwiseAND(F.col("t.mask")).alias("key"))
    lookups = classes.select(F.col("fp").alias("a"), F.col("root").alias("a_root"), F.explode(probes).alias("p"))
    lookups = lookups.filter(F.col("a").bitwiseAND(F.col("p.flip")) == 0).select(
        "a", "a_root", F.col("p.seg").alias("seg"),
        F.col("a").bitwiseAND(F.col("p.mask")).bitwiseXOR(F.col("p.flip")).alias("key"),
    )
    per_root = members.groupBy("seg", "key", "b_root").agg(F.count(F.lit(1)).alias("n"))
    buckets = per_root.groupBy("seg", "key").agg(F.max_by("b_root", "n").alias("major"), F.count(F.lit(1)).alias("roots"))
    # Members of a bucket's largest group are shown to the others only, and are shown only these.
    minor = F.col("b_root") != F.col("major")
    shown = members.join(buckets.drop("roots").hint("merge"), ["seg", "key"]).withColumn("side", F.explode(F.when(minor, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    mixed = lookups.join(buckets.hint("merge"), ["seg", "key"]).filter((F.col("roots") > 1) | (F.col("major") != F.col("a_root")))
    mixed = mixed.withColumn("side", (F.col("a_root") == F.col("major")).cast("int"))
    return mixed.drop("major", "roots").join(shown.drop("major").hint("merge"), ["seg", "key", "side"])


def searched_links(classes: DataFrame, limit: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) that join all close classes, at most one for a fp and a root."""
    met = compared(classes, limit, blocks)
    near = met.filter((F.col("a_root") != F.col("b_root")) & (distance(F.col("a"), F.col("b")) <= limit))
    return near.groupBy("a", "b_root").agg(F.min("b").alias("b")).select("a", "b")


def _rooted(distinct: DataFrame, links: DataFrame) -> DataFrame:
    found = connected(links)
    return distinct.join(found, distinct["fp"] == found["node"], "left").select(
        "fp", F.coalesce("root", "fp").alias("root")
    )


def links_of(distinct: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``distinct`` (fp) which differ in at most ``limit`` bits; stored."""
    first = stored(sorted_links(distinct, limit))
    begun = stored(_rooted(distinct, first))
    return stored(first.unionByName(searched_links(begun, limit)))


def classes_of(fps: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """Every distinct fingerprint (``fp``) with the least fingerprint it is connected to (``root``)."""
    distinct = stored(fps.select("fp").distinct())
    return _rooted(distinct, links_of(distinct, limit))


def rooted_rows(docs: DataFrame, key: str, text: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(key, digest, fp) of every row, and (fp, root) of every fingerprint; both stored."""
    digested = docs.select(F.col(f"`{key}`").alias("key"), F.xxhash64(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    marked = stored(fingerprints(digested, ["key", "digest"], "text", "fp"))
    return marked, stored(classes_of(marked, limit))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = DISTANCE) -> DataFrame:
    """One row per document: ``key``, its fingerprint ``fp`` and ``group``, the least key of its group."""
    marked, roots = rooted_rows(docs, key, text, limit)
    named = marked.groupBy("fp").agg(F.min("key").alias("least")).join(roots, "fp")
    least = stored(named.groupBy("root").agg(F.min("least").alias("group"), F.count(F.lit(1)).alias("n")))
    prints = joined_spread(roots, least, "root", "n", roots.count())
    copies = marked.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    by_print = stored(prints.join(copies, "fp").select("fp", "group", "n"))
    return joined_spread(marked, by_print, "fp", "n", marked.count()).select(F.col("key").alias(key), "fp", "group")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = DISTANCE) -> DataFrame:
    """The row of ``docs`` with the least key of each group (null keys last, then the least text digest)."""
    marked, roots = rooted_rows(docs, key, text, limit)
    place = F.struct(F.col("key").isNull().alias("absent"), "key", "digest")
    by_print = marked.groupBy("fp").agg(F.min(place).alias("first")).join(roots, "fp")
    first = by_print.groupBy("root").agg(F.min("first").alias("first"))
    chosen = first.select(F.col("first.key").alias("__key"), F.col("first.digest").alias("__digest"))
    names = {c: f"__kept{i}" for i, c in enumerate(docs.columns)}
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    met = F.col(names[key]).eqNullSafe(F.col("__key")) & (F.xxhash64(names[text]) == F.col("__digest"))
    # A group has one such key and digest; rows that repeat both are copies of it.
    return whole.join(chosen, met).dropDuplicates(["__key", "__digest"]).select(*[F.col(n).alias(c) for c, n in names.items()])


# --- similar texts, by the rarest shingles ------------------------------------------------


WORDS = 5
SIMILARITY = 0.8
SEGMENT_BITS, SEGMENTS = 20, 12
CHECK_DISTANCE = 20
SENT_NODES = 500_000
# Cells in which shingles are counted, words of short parities, most turns before all groups of a bucket meet,
# pairs for each place in a bucket at which they meet at once.
CELLS = 1 << 20
PARITIES = 4
TURNS = 4
FEW_PAIRS = 2


def similarity(a: str | None, b: str | None) -> float:
    """The share of common shingles of five words among all different ones of both texts; 1 for two texts without words."""
    x, y = np.unique(shingle_hashes(a, WORDS)), np.unique(shingle_hashes(b, WORDS))
    common = len(np.intersect1d(x, y, assume_unique=True))
    every = len(x) + len(y) - common
    return common / every if every else 1.0


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _segment(i: int) -> Column:
    """Segment ``i`` with its number above it: three to a word."""
    per_word = SEGMENTS // 4
    bits = F.shiftrightunsigned(F.col(f"w{i // per_word}"), SEGMENT_BITS * (i % per_word)).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    return bits.bitwiseOR(F.lit(i << SEGMENT_BITS).cast("long"))


def met_in_segments(rooted: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with different roots that agree in a segment up to one bit and nearly in the check word.

    Each segment's Hamming ball of radius 1 is looked up; it only turns 0 into 1, for one
    of two keys that differ in a bit has a 0 there.  A bucket shows one member of each
    root, another one in each bucket, so the work grows with members times roots.
    """
    keys = F.explode(F.array(*[_segment(i) for i in range(SEGMENTS)])).alias("key")
    mixed = F.struct(F.xxhash64("key", "node").alias("place"), "node", "check")
    members = rooted.select("node", "root", F.col("w4").alias("check"), keys).groupBy("key", "root").agg(F.min(mixed).alias("shown"))
    members = members.select("key", F.col("root").alias("b_root"), F.col("shown.node").alias("b"), F.col("shown.check").alias("b_check"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << b).cast("long") for b in range(SEGMENT_BITS)])
    asked = rooted.select(F.col("node").alias("a"), F.col("root").alias("a_root"), F.col("w4").alias("a_check"), keys)
    asked = asked.select("*", F.explode(flips).alias("flip")).filter(F.col("key").bitwiseAND(F.col("flip")) == 0)
    asked = asked.withColumn("key", F.col("key").bitwiseOR(F.col("flip"))).drop("flip")
    met = asked.join(members, "key").filter((F.col("a_root") != F.col("b_root")) & (distance(F.col("a_check"), F.col("b_check")) <= CHECK_DISTANCE))
    return ordered_pairs(met.select("a", "b"))


def confirmed(pairs: DataFrame, named: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The pairs of nodes whose texts, among those of ``named`` (node, text), are at least ``least`` similar; both stored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 64) for b in batches for at in range(0, b.num_rows, 64)):
            keep = [similarity(x.as_py(), y.as_py()) >= least for x, y in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = stored(pairs)
    needed = stored(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    # Only texts of candidates move; their numbers are sent to every task while they are few.
    asked = F.broadcast(needed) if needed.count() <= SENT_NODES else needed
    texts = named.select("node", "text").join(asked, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = stored(texts)
    both = pairs.join(texts.withColumnsRenamed({"node": "a", "text": "a_text"}), "a").join(texts.withColumnsRenamed({"node": "b", "text": "b_text"}), "b")
    return stored(both.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long"))


def shingle_levels(named: DataFrame) -> np.ndarray:
    """How frequent the shingles of each of ``CELLS`` cells are, as the number of bits of their count.

    Counted in every task and then per slice, so the driver gets one byte a cell.
    """
    slices = 32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, many = np.zeros(CELLS, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(cells_of(np.unique(shingle_hashes(text.as_py(), WORDS))))
                many += len(held[-1])
                if many >= CELLS // 4:
                    total += np.bincount(np.concatenate(held), minlength=CELLS)
                    held, many = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS)
        for i, part in enumerate(np.array_split(total, slices)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[i] = sums.get(i, 0) + np.frombuffer(zlib.decompress(part), np.int64)
        for i, total in sums.items():
            levels = np.ceil(np.log2(total + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([levels.tobytes()], pa.binary())], names=["slice", "counts"])

    schema = "slice int, counts binary"
    found = named.select("text").mapInArrow(count, schema).repartition(slices, "slice").mapInArrow(add_up, schema).collect()
    levels = np.array_split(np.zeros(CELLS, np.uint8), slices)
    for r in found:
        levels[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return np.concatenate(levels)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(20)).astype(np.int64) % CELLS


def parity_bits(hashes: np.ndarray) -> np.ndarray:
    """Whether an odd number of ``hashes`` fell to each cell, as bytes of bits: a power of two of cells, as many as hashes or more.

    Two texts differ in at least as many shingles as bits.  Long bits are folded to fewer by exclusive or.
    """
    cells = max(64 * PARITIES, 1 << (max(len(hashes), 1) - 1).bit_length())
    odd = np.bincount((hashes >> np.uint64(32)).astype(np.int64) % cells, minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def bits_apart(a: bytes, b: bytes) -> int:
    """The bits in which two parities differ, the longer folded to the size of the other."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64))


def prefixes(named: DataFrame, levels: np.ndarray, least: float) -> DataFrame:
    """(key, node, fp, n, w0 ... w3, parity, prefix) for (key, node, text): the fingerprint of all shingles, the number of different ones, their parities (short and whole), the rarest of them.

    Two texts that share ``least`` of their shingles share one of their prefixes.
    """
    shared = named.sparkSession.sparkContext.broadcast(levels)
    words = [T.StructField(f"w{i}", T.LongType()) for i in range(PARITIES)]
    schema = T.StructType([
        named.schema["key"], T.StructField("node", T.LongType()), T.StructField("fp", T.LongType()), T.StructField("n", T.LongType()), *words,
        T.StructField("parity", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType())),
    ])

    def one(text: str | None, level: np.ndarray) -> tuple:
        every = shingle_hashes(text, WORDS)
        hashes = np.unique(every)
        n = len(hashes)
        parity = parity_bits(hashes)
        rarest = hashes[np.argsort(level[cells_of(hashes)], kind="stable")][: n - int(np.ceil(least * n - 1e-9)) + 1]
        # Texts without words have nothing but each other.
        return n, folded(parity, 8 * PARITIES).view(np.int64), parity.tobytes(), rarest.view(np.int64).tolist() if n else [0], majority(every) if n else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            found = [one(x.as_py(), level) for x in batch.column(2)]
            parities = np.array([f[1] for f in found], np.int64).reshape(-1, PARITIES)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[4] for f in found], pa.int64()), pa.array([f[0] for f in found], pa.int64()), *[pa.array(c) for c in parities.T],
                 pa.array([f[2] for f in found], pa.binary()), pa.array([f[3] for f in found], pa.list_(pa.int64()))], names=schema.names,
            )

    return named.select("key", "node", "text").mapInArrow(run, schema)


def may_share(n: Column, pos: Column, other_n: Column, other_pos: Column, least: float) -> Column:
    """Whether two texts of ``n`` shingles whose first common one stands at these places (from 0) can share ``least``."""
    slack = 1e-6
    sizes = F.least(n, other_n) >= F.greatest(n, other_n) * least - slack
    # The first shingle they share stands so early that enough follow.
    return sizes & (F.least(n - pos, other_n - other_pos) >= (n + other_n) * (least / (1 + least)) - slack)


def may_reach(a: str, b: str, least: float) -> Column:
    """Whether rows ``a`` and ``b`` of one bucket can share ``least`` of their shingles; never false for two that do."""
    c = lambda side, name: F.col(f"{side}.{name}")
    apart = sum((distance(c(a, f"w{i}"), c(b, f"w{i}")) for i in range(1, PARITIES)), distance(c(a, "w0"), c(b, "w0")))
    few = apart <= (c(a, "n") + c(b, "n")) * ((1 - least) / (1 + least)) + 1e-6
    return may_share(c(a, "n"), c(a, "pos"), c(b, "n"), c(b, "pos"), least) & few


def buckets_of(postings: DataFrame, turn: int) -> DataFrame:
    """(key, many, and node, n, pos, root of the one it shows in this turn) of every bucket with several roots.

    The one with the fewest rarer shingles is shown: it has least of its own, so what links to another of a group
    mostly links to it.  Ties depend on the turn and the node only, so the buckets of a group mostly show the same one.
    """
    mixed = F.col("node").bitwiseXOR(F.lit(_signed(xxh64_intdigest(str(turn).encode(), SEED))))
    mixed = F.shiftleft(F.least("pos", F.lit(1 << 22)).cast("long"), 40).bitwiseOR(F.shiftrightunsigned(mixed, 24))
    found = postings.groupBy("key").agg(
        F.count(F.lit(1)).alias("many"), F.min("root").alias("__least"), F.max("root").alias("__most"),
        *[F.min_by(c, mixed).alias(f"shown_{c}") for c in ("node", "n", "pos", "root")],
    )
    return found.filter("many > 1 AND __least <> __most").drop("__least", "__most")


def within_parity(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose whole parities allow ``least``; of texts that share less, few are left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * ((1 - least) / (1 + least)) + 1e-6
            keep = [bits_apart(x.as_py(), y.as_py()) <= m for x, y, m in zip(batch.column(4), batch.column(5), most)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    for side in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("parity").alias(f"{side}_parity")), side)
    return pairs.select("a", "b", "a_n", "b_n", "a_parity", "b_parity").mapInArrow(run, "a long, b long")


def met_in_buckets(postings: DataFrame, least: float) -> DataFrame:
    """All pairs (a, b) of nodes with different roots that meet in a bucket and may be similar.

    Members of a bucket's largest group are compared with the others only.
    """
    per_root = postings.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = per_root.groupBy("key").agg(F.max_by("root", "n").alias("major"), F.count(F.lit(1)).alias("roots")).filter("roots > 1")
    held = stored(postings.join(mixed.select("key", "major"), "key"))
    a, b = held.filter("root <> major").alias("a"), held.alias("b")
    once = (F.col("b.root") == F.col("b.major")) | (F.col("a.node") < F.col("b.node"))
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.root") != F.col("b.root")) & once & may_reach("a", "b", least))
    return ordered_pairs(met.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")))


def print_pairs(nodes: DataFrame, limit: int = DISTANCE) -> DataFrame:
    """Pairs (a, b) that connect all ``nodes`` (node, fp) whose fingerprints differ in at most ``limit`` bits.

    Each fingerprint goes by its least node, and its other nodes are paired with that one.
    """
    named = stored(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    links = links_of(named.select("fp"), limit)
    for side in ("a", "b"):
        links = links.join(named.select(F.col("fp").alias(side), F.col("first").alias(f"{side}_first")), side)
    copies = nodes.join(named, "fp").filter("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return ordered_pairs(links.select(F.col("a_first").alias("a"), F.col("b_first").alias("b")).unionByName(copies))


def similar_links(nodes: DataFrame, named: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Confirmed links (a, b) that connect all texts which share ``least`` of their shingles, directly or by way of others.

    ``nodes`` has (node, fp, n, w0 ... w3, parity, prefix).  Only shingles in two prefixes or more are buckets;
    nodes in none are similar to no other.  The rest is first linked by fingerprints, and what these miss is met in the buckets.
    A node that its bucket has shown to all others leaves the bucket, and buckets of one root are done.
    """
    def rooted(postings: DataFrame) -> DataFrame:
        return stored(postings.join(connected(links), "node", "left").withColumn("root", F.coalesce("root", "node")))

    entries = nodes.select("node", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "key"))
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1").select("key")
    # Spark sizes the exploded prefixes as one shingle a text.
    postings = stored(entries.join(several.hint("merge"), "key"))
    met_at_all = nodes.select("node", "fp").join(postings.select("node").distinct(), "node", "left_semi")
    links = confirmed(within_parity(print_pairs(stored(met_at_all)), nodes, least), named, least)
    postings = rooted(postings)
    for turn in range(TURNS + 1):
        buckets = stored(buckets_of(postings, turn))
        members, pairs_left = buckets.agg(F.sum("many"), F.sum(F.col("many").cast("double") * (F.col("many") - 1) / 2)).head()
        if not members:
            break
        last = turn == TURNS or pairs_left <= FEW_PAIRS * members
        if last:
            words = nodes.select("node", *[f"w{i}" for i in range(PARITIES)])
            pairs = met_in_buckets(postings.join(buckets.select("key"), "key", "left_semi").join(words, "node"), least)
        else:
            met = stored(postings.join(buckets, "key").filter("node <> shown_node"))
            c = F.col
            near = met.filter((c("root") != c("shown_root")) & may_share(c("n"), c("pos"), c("shown_n"), c("shown_pos"), least))
            pairs = ordered_pairs(near.select(c("node").alias("a"), c("shown_node").alias("b")))
        new = confirmed(within_parity(pairs, nodes, least), named, least)
        links = stored(links.unionByName(new))
        if last:
            break
        postings = rooted(met.filter("many > 2").select("key", "node", "n", "pos"))
    return links


def keep_one_similar(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The row of ``docs`` with the least key of each group of similar texts (null keys last, then the least text digest).

    Texts link if they share at least ``least`` of their shingles of five words.  SimHash fingerprints
    of these shingles link most of a group: the search of ``classes_of``, its pairs confirmed on their
    texts.  What fingerprints miss is found exactly: with all shingles in one order, rare ones first, two such texts share one of
    the first 1 - ``least`` of each (a prefix), and bounds on sizes, places and parities refuse
    only pairs below ``least``.  In up to ``TURNS`` turns each text is compared with one text of each of its
    buckets, another in each turn, which joins most of a group by a few pairs a text; when few pairs
    are left, or after the last turn, all texts of a bucket that are in different groups meet.  Only
    confirmed pairs link.
    """
    named = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("node", F.xxhash64("text"))
    place = F.struct(F.col("key").isNull().alias("absent"), "key")
    marked = prefixes(named, shingle_levels(named), least)
    others = ["fp", "n", *[f"w{i}" for i in range(PARITIES)], "parity", "prefix"]
    nodes = stored(marked.groupBy("node").agg(F.min(place).alias("place"), *[F.first(c).alias(c) for c in others]))
    links = similar_links(nodes, named, least)
    held = nodes.select("node", "place").join(connected(links), "node", "left")
    first = held.groupBy(F.coalesce("root", "node").alias("root")).agg(F.min(F.struct("place", "node")).alias("first"))
    names = {c: f"__kept{i}" for i, c in enumerate(docs.columns)}
    whole = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])

    def placed_by(key: Column, node: Column) -> list[Column]:
        return [node.alias("__node"), F.coalesce(key.cast("string"), F.lit("")).alias("__name"), key.isNull().alias("__absent")]

    chosen = first.select(*placed_by(F.col("first.place.key"), F.col("first.node")))
    whole = whole.select("*", *placed_by(F.col(names[key]), F.xxhash64(F.col(names[text]).cast("string"))))
    # Joined and freed of copies by the same columns, so the texts move once.
    same = ["__node", "__name", "__absent"]
    return whole.join(chosen.hint("merge"), same).dropDuplicates(same).select(*[F.col(n).alias(c) for c, n in names.items()])
