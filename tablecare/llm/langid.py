"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the runs of 2, 3 and 4 bytes of its lower-cased letters, words
parted by one space.  Each is hashed to one of ``BUCKETS`` embeddings; the embeddings
are averaged over the whole text and a linear layer with softmax gives the languages.

Training reads every labelled row that is not held out.  Rows are dealt by hash into blocks
of about ``BLOCK``; each block learns in one task (numpy, stochastic gradient descent), and
the linear layers over the buckets, which embeddings and softmax layer multiply to, are
averaged over the blocks by their rows.  Every fifth row also gives the same characters in
an order that no language has, as a class of its own: junk.  The driver gets one sum of
weights per model, however many rows there are.

The score is the probability of the best language.  Rejection is calibrated out of fold on
all these rows: blocks (of a single block, its rows) are dealt to ``FOLDS`` folds, and each row
is scored by the average of what was learned outside its fold.
A temperature fits these scores to the truth; its targets are smoothed by one row in n + 2,
so it is finite however well the languages part.  The threshold is the lowest that accepts
no more than ``PASSED`` of new junk, unless that loses more than ``LOST`` of new right
predictions.  Both are conformal ranks, floor(rate x (n + 1)) of the n scores, found by
counting: too few scores for a rate set no bound, by the same formula at every size.  The
model carries the shares of both errors on the calibrating scores, ``lost`` and ``passed``.

Defined cases: a text that is null or has no letter is ``und`` with score 0 and
rejected; with no labelled rows every text is ``und``; a null label is no language;
ties go to the language that sorts first; equal rows get equal results; empty tables
give empty results.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried, stored

BUCKETS = 1 << 12
LENGTHS = (2, 3, 4)
DIMENSIONS = 16
BLOCK = 2500
EPOCHS = 20
BATCH = 64
RATE = 2.0
FOLDS = 3
LOST = 0.005
PASSED = 0.01
UNIT = 1 << 20
SECTIONS = 64
UNKNOWN = "und"
SLICE = 1 << 20

# Letters and all bytes beyond ASCII stay; everything else parts words.
LETTER_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text)))


def word_slices(text: str) -> Iterator[list[bytes]]:
    """The words of a whole text, in lists of about ``SLICE`` characters that never part a word."""
    held: list[bytes] = []
    for at in range(0, len(text), SLICE):
        part = text[at : at + SLICE].lower().encode("utf-8", "replace").translate(LETTER_BYTES)
        cut = part.rfind(b" ")
        if cut < 0:
            held.append(part)
            continue
        yield (b"".join(held) + part[:cut]).split()
        held = [part[cut + 1 :]]
    yield b"".join(held).split()


def bucket_counts(text: str) -> np.ndarray:
    """How often each bucket is met by the subwords of the whole text."""
    counts = np.zeros(BUCKETS, np.int64)
    for words in word_slices(text):
        data = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint32)
        code = data
        for n in range(2, max(LENGTHS) + 1):
            code = (code[:-1] << np.uint32(8)) | data[n - 1 :] if len(code) > 1 else code[:0]
            if n in LENGTHS and len(code):
                mixed = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
                mixed ^= mixed >> np.uint32(15)
                mixed *= np.uint32(0x85EBCA77)
                counts += np.bincount(mixed >> np.uint32(33 - BUCKETS.bit_length()), minlength=BUCKETS)
    return counts


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float
    lost: float = float("nan")
    passed: float = float("nan")

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """The linear layer over rows of bucket counts."""
        return (counts @ self.weights) / np.maximum(counts.sum(1, keepdims=True), 1e-9) + self.bias

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """One row of the languages' probabilities per row of bucket counts; the rest to 1 is junk."""
        return softmax(self.scores(counts) / self.temperature)[:, : len(self.languages)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Sample:
    """Texts as the buckets they meet, with their class and the number of the text they were made from."""

    places: list[np.ndarray]
    shares: list[np.ndarray]
    classes: np.ndarray
    texts: np.ndarray

    def dense(self, rows: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), BUCKETS), np.float32)
        for x, i in zip(out, rows):
            x[self.places[i]] = self.shares[i]
        return out


def learned(sample: Sample, train: np.ndarray, classes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embeddings times softmax layer, and its bias, from the rows ``train`` by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, classes)).astype(np.float32)
    bias = np.zeros(classes, np.float32)
    wanted = np.eye(classes, dtype=np.float32)
    # Mean embeddings are short, so their gradient is scaled up to the number of buckets met.
    met = float(np.mean([np.square(sample.shares[i]).sum() for i in train]))
    gain = np.float32(min(1 / max(met, 1e-6), 100))
    for epoch in range(EPOCHS):
        rate = np.float32(RATE * (1 - epoch / EPOCHS))
        order = rng.permutation(train)
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            x = sample.dense(rows)
            mean = x @ embeddings
            error = (softmax(mean @ layer + bias) - wanted[sample.classes[rows]]) / len(rows)
            step = x.T @ (error @ layer.T)
            layer -= rate * (mean.T @ error)
            bias -= rate * error.sum(0) * np.float32(0.1)
            embeddings -= rate * gain * step
    return (embeddings @ layer).astype(np.float64), bias.astype(np.float64)


def shuffled(text: str, seed: int) -> str:
    """The characters of a text in an order that no language has."""
    return "".join(random.Random(seed).sample(text, len(text)))


def held_out(key: Column) -> Column:
    """Rows that never train: crc32 of the key as text, modulo 3, is 1."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers, whose sums are the same in any order."""
    return np.rint(np.asarray(x, np.float64) * UNIT).astype(np.int64)


def bucketed(number: int, label: int, junk: int, text: str, mark: int) -> Iterator[tuple]:
    """(buckets, shares, class, ``number``) of a text, and of its shuffled characters as junk if it is a fifth one."""
    for real in (True, False)[: 1 + (mark % 5 == 0 and has_letter(text))]:
        counts = bucket_counts(text if real else shuffled(text, mark))
        met = np.flatnonzero(counts)
        yield met.astype(np.uint16), (counts[met] / max(counts.sum(), 1)).astype(np.float32), label if real else junk, number


def block_models(dealt: DataFrame, languages: list[str], folds: int, single: bool) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The mean weights and bias by who may be judged: -1 learned from all blocks, k from everything outside fold k.

    Each block learns in one task.  Sums are whole numbers, added up in every task and
    then per slice of the weights, so the driver gets one sum per model.
    """
    classes = len(languages) + 1
    slices = 32

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def add(target: int, sample: Sample, rows: np.ndarray) -> None:
            weights, bias = learned(sample, rows, classes)
            one = np.concatenate([fixed(weights).ravel(), fixed(bias), [UNIT]]) * len(rows)
            for t in [target] if single else [-1, *[k for k in range(folds) if k != target]]:
                sums[t] = sums[t] + one if t in sums else one

        def close(held: list[tuple], fold: int) -> None:
            places, shares, kinds, texts = zip(*held)
            sample = Sample(list(places), list(shares), np.array(kinds), np.array(texts))
            every = np.arange(len(sample.classes))
            if not single:
                add(fold, sample, every)
                return
            add(-1, sample, every)
            for k in range(folds):
                rows = every[sample.texts != k]
                if 0 < len(rows) < len(every):
                    add(k, sample, rows)

        held, block, fold = [], None, 0
        for batch in batches:
            for b, f, mark, label, text in zip(*[batch.column(c) for c in ("block", "fold", "mark", "label", "text")]):
                # Rows equal in key and text share a block of any size; it learns in parts.
                if held and (b.as_py() != block or len(held) >= 2 * BLOCK):
                    close(held, fold)
                    held = []
                block, fold = b.as_py(), f.as_py()
                held += bucketed(fold, languages.index(label.as_py()), len(languages), text.as_py(), mark.as_py())
        if held:
            close(held, fold)
        for target, total in sums.items():
            parts = np.array_split(total, slices)
            yield pa.RecordBatch.from_arrays(
                [pa.array([target] * slices, pa.int32()), pa.array(range(slices), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())],
                names=["target", "slice", "sums"],
            )

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for target, at, part in zip(*[batch.column(c).to_pylist() for c in ("target", "slice", "sums")]):
                part = np.frombuffer(part, np.int64)
                sums[target, at] = sums[target, at] + part if (target, at) in sums else part
        for (target, at), total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([target], pa.int32()), pa.array([at], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["target", "slice", "sums"]
            )

    schema = "target int, slice int, sums binary"
    found = dealt.mapInArrow(learn, schema).repartition(slices, "target", "slice").mapInArrow(add_up, schema).collect()
    models = {}
    for target in {r["target"] for r in found}:
        total = np.concatenate([np.frombuffer(r["sums"], np.int64) for r in sorted(found, key=lambda r: r["slice"]) if r["target"] == target])
        mean = total[:-1] / total[-1]
        models[target] = mean[: BUCKETS * classes].reshape(BUCKETS, classes), mean[BUCKETS * classes :]
    return models


def judged(rows: DataFrame, models: dict[int, tuple[np.ndarray, np.ndarray]], languages: list[str]) -> DataFrame:
    """(class, scores) of every labelled row and of its junk, by a model that did not learn from it; stored."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {k: Model(languages, w, b, 1.0, 0.0) for k, (w, b) in shared.value.items()}
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            kinds, scores = [], []
            for fold, mark, label, text in zip(*[batch.column(c) for c in ("fold", "mark", "label", "text")]):
                model, said = known.get(fold.as_py()), text.as_py()
                if model is None or not has_letter(said):
                    continue
                for real in (True, False)[: 1 + (mark.as_py() % 5 == 0)]:
                    counts = bucket_counts(said if real else shuffled(said, mark.as_py()))
                    kinds.append(languages.index(label.as_py()) if real else len(languages))
                    scores.append(model.scores(counts[None, :])[0].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(scores, pa.list_(pa.float64()))], names=["class", "scores"])

    return stored(rows.select("fold", "mark", "label", "text").mapInArrow(run, "class int, scores array<double>"))


def _scores_of(batch: pa.RecordBatch, many: int) -> tuple[np.ndarray, np.ndarray]:
    scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False).reshape(-1, many)
    return batch.column("class").to_numpy(zero_copy_only=False), scores


def fitted_temperature(scored: DataFrame, n: int, many: int) -> float:
    """The temperature of least cross entropy, with targets smoothed by one row in n + 2.

    The slope grows with the inverse temperature; each pass over the scores cuts the
    range that holds its zero into ``SECTIONS``.
    """
    if n == 0:
        return 1.0
    low, high = 1e-3, 1e6
    for _ in range(4):
        tried = np.geomspace(low, high, SECTIONS + 1)

        def slopes(batches: Iterator[pa.RecordBatch], tried=tried) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(tried), np.int64)
            for batch in batches:
                kinds, x = _scores_of(batch, many)
                wanted = x.sum(1) / (n + 2) / many + (1 - 1 / (n + 2)) * x[np.arange(len(x)), kinds]
                total += np.array([fixed((softmax(x * m) * x).sum(1) - wanted).sum() for m in tried])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(tried)), pa.int32()), pa.array(total)], names=["i", "slope"])

        found = scored.mapInArrow(slopes, "i int, slope long").groupBy("i").agg(F.sum("slope").alias("slope")).collect()
        below = [r["i"] for r in found if r["slope"] < 0]
        at = min(max(below, default=0), SECTIONS - 1)
        low, high = float(tried[at]), float(tried[at + 1])
    return 1 / (low * high) ** 0.5


def ranked(best: DataFrame, ranks: dict[bool, int]) -> dict[bool, float]:
    """Per kind (``right``) the score of a rank from 1, by counting the scores' bits, 16 at a time."""
    prefix, left = {k: 0 for k in ranks}, dict(ranks)
    for shift in (48, 32, 16, 0):
        at = F.shiftright("bits", shift)
        inside = F.lit(shift == 48)
        for k in ranks:
            inside = inside | ((F.col("right") == k) & (F.shiftright(at, 16) == F.lit(prefix[k])))
        counts = best.filter(inside).groupBy("right", at.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()
        for k in ranks:
            for r in sorted((r for r in counts if r["right"] == k), key=lambda r: r["cell"]):
                if left[k] <= r["n"]:
                    prefix[k] = r["cell"]
                    break
                left[k] -= r["n"]
    return {k: float(np.int64(v).view(np.float64)) for k, v in prefix.items()}


def calibrate(model: Model, scored: DataFrame, many: int) -> None:
    """Set the temperature, the threshold and both errors from the scores out of fold of all rows."""
    model.temperature = fitted_temperature(scored, scored.count(), many)
    temperature = model.temperature

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, x = _scores_of(batch, many)
            p = softmax(x / temperature)[:, :-1]
            junk, right = kinds == many - 1, p.argmax(1) == kinds
            bits = np.ascontiguousarray(p.max(1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(~junk[junk | right]), pa.array(bits[junk | right])], names=["right", "bits"])

    best = stored(scored.mapInArrow(run, "right boolean, bits long"))
    n = {True: 0, False: 0} | {r["right"]: r["count"] for r in best.groupBy("right").count().collect()}
    most_lost, most_passed = int(LOST * (n[True] + 1)), int(PASSED * (n[False] + 1))
    ranks = ({True: most_lost} if most_lost else {}) | ({False: n[False] - most_passed + 1} if most_passed else {})
    found = ranked(best, ranks) if ranks else {}
    model.threshold = found.get(True, 0.0)
    if most_passed:
        model.threshold = min(model.threshold, float(np.nextafter(found[False], 2)))
    # Scores are not negative, so their bits are in their order.
    bound = F.lit(int(np.float64(model.threshold).view(np.int64)))
    low, high = best.agg(F.count_if(F.col("right") & (F.col("bits") < bound)), F.count_if(~F.col("right") & (F.col("bits") >= bound))).head()
    model.lost = low / n[True] if n[True] else float("nan")
    model.passed = high / n[False] if n[False] else float("nan")


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> Model | None:
    """The model of all labelled rows that are not held out."""
    rows = docs.filter(~held_out(F.col(f"`{key}`")) & F.col(f"`{label}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    rows = rows.select(F.xxhash64(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("mark"), F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label"))
    per_label = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if not per_label:
        return None
    languages = sorted(per_label)
    blocks = -(-sum(per_label.values()) // BLOCK)
    folds = min(FOLDS, blocks) if blocks > 1 else FOLDS
    block = F.pmod(F.xxhash64(F.lit("block"), "mark"), F.lit(blocks)).cast("int")
    fold = F.pmod(block if blocks > 1 else F.xxhash64(F.lit("fold"), "mark"), F.lit(folds)).cast("int")
    rows = rows.select(block.alias("block"), fold.alias("fold"), "mark", "label", "text")
    dealt = rows.repartition(blocks, "block").sortWithinPartitions("block", "mark", "label", "text")
    models = block_models(dealt, languages, folds, blocks == 1)
    weights, bias = models.pop(-1)
    model = Model(languages, weights, bias, 1.0, 0.0)
    calibrate(model, judged(rows, models, languages), len(languages) + 1)
    return model


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, then ``lang_pred``, ``score`` and ``accepted``."""
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]
    keep = [c for c in keep if c not in ("lang_pred", "score", "accepted")]
    taken, at_text = carried(docs, keep, text)
    schema = T.StructType([*taken.schema.fields[: len(keep)], *added])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for whole in batches:
            # Dense counts of few rows at a time: 32 KB a row, several times over.
            for at in range(0, whole.num_rows, 128):
                batch = whole.slice(at, 128)
                names, scores = [UNKNOWN] * batch.num_rows, [0.0] * batch.num_rows
                texts = [x.as_py() for x in batch.column(at_text)]
                told = [i for i, t in enumerate(texts) if known and has_letter(t)]
                if told:
                    p = known.probabilities(np.array([bucket_counts(texts[i]) for i in told]))
                    for i, best, score in zip(told, p.argmax(1).tolist(), p.max(1).tolist()):
                        names[i], scores[i] = known.languages[best], score
                accepted = [n != UNKNOWN and s >= known.threshold for n, s in zip(names, scores)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())],
                    names=schema.names,
                )

    return taken.mapInArrow(run, schema).select(*[F.col(f"__kept{i}").alias(c) for i, c in enumerate(keep)], *[f.name for f in added])
