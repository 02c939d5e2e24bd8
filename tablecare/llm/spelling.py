"""Spelling variants: words one edit apart, grouped under the most frequent form, by pivotal grams.

Words are the runs of letters of whole texts, counted over all of them.  Two words are
near if one inserted, deleted or replaced code point makes one the other.

Every word is cut into its bigrams with their places.  Bigrams are ranked by the number
of words that hold them, rare first.  A word's prefix is its three rarest bigrams (of
equal ones the first), and two of them that do not overlap are its pivots, chosen by
dynamic programming for the least sum of ranks.  One edit spoils at most one of the two,
so of two near words the one whose prefix ends no later in the ranking has a pivot that
stands, moved by at most one place, in the other and ranks no later than its prefix ends.
A pivot has at most two equal bigrams before it and an edit adds at most two, so the
prefixes are indexed with up to ``PLACES`` = 5 places of their last bigram, and pivots
looked up.

Position limits: for each length that the other word may have, an edit behind the pivot
fixes the pivot's place from the start and one before it that from the end.  All that
stands on the other side is equal, and of the side with the edit one half is; both are
part of the lookup, so words that only share a frequent bigram are never paired.
Candidates are verified by their edit distance.

A word's form is the near word that occurs most often, if at least ``TIMES`` times as
often; roots follow forms to the last one.  Counts double with each step, so the chains
are short and pointer jumping ends after a few rounds, each stored.

Only words and counts are shuffled, partly counted in each task.  The ranking is one
number per bigram of the alphabet, at most 90 x 90, which is what is broadcast.

Defined cases: a null text has no words; a null key is written as empty text; a run is
held in memory whole; ties between near words go to the smallest in code-point order;
rows that repeat are counted each; empty tables give empty results.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import stored

LEAST_LENGTH = 5
LEAST_COUNT = 3
TIMES = 2
PREFIX = 3
PLACES = 5
SLICE = 1 << 20
FLUSH = 200_000
SHORT = 64

# Latin-1: letters stay, A-Z in lower case; all else parts words.
LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0xC0 else 0x20 for b in range(256)
)

Gram = tuple[int, int]  # rank, place


def runs(text: str) -> Iterator[list[bytes]]:
    """The lower-cased letter runs of a whole text in Latin-1, slice by slice."""
    held: list[bytes] = []
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE].encode("latin-1", "replace").translate(LETTERS)
        cut = part.rfind(b" ")
        if cut < 0:
            held.append(part)
            continue
        yield (b"".join(held) + part[:cut]).split()
        held = [part[cut + 1 :]]
    yield b"".join(held).split()


def word_counts(
    docs: DataFrame, key: str = "doc_id", text: str = "text", edit: Callable[[str, bytes], bytes] | None = None,
    least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """(word, n): the words of all texts; ``edit`` may change each run of a text, given the text's key."""
    taken = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").cast("string").alias("text"))

    def batch_of(counts: Counter) -> pa.RecordBatch:
        words = [w.decode("latin-1") for w in counts]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                if not value.is_valid:
                    continue
                name = key.as_py()
                for words in runs(value.as_py()):
                    for word, n in Counter(words).items():
                        word = edit(name, word) if edit else word
                        if len(word) >= least_length:
                            counts[word] += n
                    if len(counts) >= FLUSH:
                        yield batch_of(counts)
                        counts = Counter()
        yield batch_of(counts)

    found = taken.filter(F.col("text").isNotNull()).mapInArrow(run, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


# --- near words ---------------------------------------------------------------------


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """Every bigram of the words, numbered from the rarest; one entry per pair of letters."""
    places = F.sequence(F.lit(1), F.length("word") - 1)
    grams = F.array_distinct(F.transform(places, lambda i: F.substring("word", i, F.lit(2))))
    held = words.filter(F.length("word") > 1).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    return {r["gram"]: i for i, r in enumerate(sorted(held.collect(), key=lambda r: (r["n"], r["gram"])))}


def prefix_of(word: str, ranks: dict[str, int]) -> tuple[list[Gram], list[Gram]]:
    """The rarest bigrams of a word with their places, and those with ``PLACES`` places of the last of them."""
    grams = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
    prefix = grams[:PREFIX]
    last = prefix[-1][0]
    further = [g for g in grams[PREFIX : PREFIX + PLACES] if g[0] == last]
    return prefix, prefix + further[: PLACES - sum(g[0] == last for g in prefix)]


def pivots_of(prefix: list[Gram]) -> list[Gram]:
    """The two bigrams of a prefix that do not overlap and have the least sum of ranks.

    By place, ``one`` is the best single bigram that ends before the present one and
    ``two`` the best pair so far.
    """
    at_place = sorted(prefix, key=lambda g: g[1])
    one: Gram | None = None
    two: tuple[int, Gram, Gram] | None = None
    behind = 0
    for gram in at_place:
        while at_place[behind][1] + 2 <= gram[1]:
            if one is None or at_place[behind] < one:
                one = at_place[behind]
            behind += 1
        if one is not None and (two is None or one[0] + gram[0] < two[0]):
            two = (one[0] + gram[0], one, gram)
    return list(two[1:]) if two else []


def _keys(word: str, gram: Gram, length: int) -> list[int]:
    """What a word and another of ``length`` share if they are one edit apart and both have the bigram ``gram``.

    ``gram`` has its place in ``word``.  The edit is behind or before it, and there in
    the first or second half of the other word's letters; the rest is equal in both.
    """
    rank, place = gram
    before, behind = word[:place], word[place + 2 :]
    keys = []
    for side, equal, other in ((0, before, behind), (1, behind, before)):
        there = length - len(equal) - 2  # letters of the other word on the side of the edit
        half = there // 2
        keys += [(side, 0, equal, other[:half]), (side, 1, equal, other[len(other) - (there - half) :])]
    return [xxh64_intdigest(f"{rank} {length} {side} {part} {equal} {same}".encode()) - (1 << 63) for side, part, equal, same in keys]


def index_keys(word: str, places: list[Gram]) -> list[int]:
    """The lookups that a word answers, for each of the bigrams it is indexed by."""
    return [k for g in places for k in _keys(word, g, len(word))]


def probe_keys(word: str, pivots: list[Gram]) -> list[int]:
    """The lookups by which a word finds the near words of each length."""
    return [k for g in pivots for longer in (-1, 0, 1) for k in _keys(word, g, len(word) + longer)]


def near_pairs(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """(a, b): every two words of ``words`` that are one edit apart, in both orders.

    A word must have four bigrams at least, so that its prefix holds two that do not overlap.
    Spark sizes the tables of keys as if each word had one, so their join is told to sort:
    they would be sent to every task by way of the driver.
    """
    shared = words.sparkSession.sparkContext.broadcast(ranks)

    def keyed(index: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in (b.slice(at, 4096) for b in batches for at in range(0, b.num_rows, 4096)):
                said, ends, keys = [], [], []
                for word in batch.column(0).to_pylist():
                    prefix, places = prefix_of(word, known)
                    some = index_keys(word, places) if index else probe_keys(word, pivots_of(prefix))
                    said += [word] * len(some)
                    ends += [prefix[-1][0]] * len(some)
                    keys += some
                yield pa.RecordBatch.from_arrays([pa.array(said, pa.string()), pa.array(ends, pa.int32()), pa.array(keys, pa.int64())], names=["word", "last", "key"])

        return run

    def table(index: bool, word: str, last: str) -> DataFrame:
        rows = words.select("word").mapInArrow(keyed(index), "word string, last int, key bigint")
        return rows.select(F.col("word").alias(word), F.col("last").alias(last), "key")

    met = table(False, "a", "a_last").join(table(True, "b", "b_last").hint("merge"), "key")
    # The JVM looks at short words; its distance takes quadratic time, so long ones are left to Python.
    likely = (F.length("a") > SHORT) | (F.levenshtein("a", "b", 1) == 1)
    met = met.filter((F.col("a_last") <= F.col("b_last")) & (F.col("a") != F.col("b")) & likely).select("a", "b")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(list(map(one_edit, batch.column(0).to_pylist(), batch.column(1).to_pylist())), pa.bool_()))

    near = met.mapInArrow(verified, met.schema)
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one inserted, deleted or replaced code point makes one word the other, in linear time."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) > len(a) + 1:
        return False
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)) :] == b[same + 1 :]


# --- forms --------------------------------------------------------------------------


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for each (word, form): the last word that forms lead to."""
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(further.hint("merge"), "root", "left").select("word", "root", "next"))
        if moved.filter(F.col("next").isNotNull()).isEmpty():
            return at
        at = moved.select("word", F.coalesce("next", "root").alias("root"))


def variants(counted: DataFrame, times: int = TIMES) -> DataFrame:
    """For each word of ``counted`` (word, n): its form, root, near words and the form's count.

    Stored words take a tenth of the room that they take in memory, so their joins are told to sort as well.
    """
    words = stored(counted.select("word", "n"))
    pairs = near_pairs(words, bigram_ranks(words))
    of = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    near = pairs.join(of.hint("merge"), "b").groupBy("a").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("form"))).alias("best")
    )
    near = near.select(F.col("a").alias("word"), "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))
    joined = words.join(near.hint("merge"), "word", "left")
    frequent = F.col("form_n") >= times * F.col("n")
    joined = stored(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(frequent, F.col("form")).alias("form"), F.when(frequent, F.col("form_n")).alias("form_n"),
    ))
    roots = roots_of(joined.filter(F.col("form").isNotNull()))
    return joined.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
