"""BPE encoding and decoding with a public tokenizer's vocabulary file.

``round_trip`` encodes whole texts as the file's pipeline does (special strings first,
then NFC, white space to one space, lower case, split into words, bytes as characters,
merges with a word-end suffix) and decodes the ids again.

The merges use a contiguous rank array: a short word is a row of parts with the ranks
of its adjacent pairs beside it.  The row is scanned for its smallest rank, the
boundary there is deleted and only the two neighbouring ranks are looked up anew, until
no pair has a rank.  Words of one length are rows of one matrix, so all new words of a
slice of text advance together; every merge shortens each live row by one.  Words over
``SHORT`` bytes use a heap of ranks instead, so that a text without spaces stays in
proportion to its length; both pick the smallest rank, leftmost first.

Texts are read in slices of bounded size that end at a space, and word results are
cached up to a fixed number of entries, so memory does not grow with a text beyond its
own output.

Defined cases: a null text is empty (no tokens, empty decoded text); special strings in
a text become their special ids; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried

SHORT = 48
SLICE = 1 << 20
CACHED = 400_000
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    stands = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [stands[b] for b in range(256)]


class Vocabulary:
    """Encoder and decoder for one vocabulary file of word BPE with an end-of-word suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ids, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in (ids | self.special).items():
            self.tokens[i] = token
        characters = byte_characters()
        self.inside = np.array([ids[c] for c in characters], np.int32)
        self.ending = np.array([ids[c + suffix] for c in characters], np.int32)
        pairs = [(ids[a], ids[b], ids[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        left, right, self.merged = (np.array(x, np.int32) for x in zip(*pairs))
        self.ranks = {(a, b): i for i, (a, b, _) in enumerate(pairs)}
        keys = self._key(left, right)
        order = np.argsort(keys)
        self.keys, self.key_ranks = keys[order], np.arange(len(keys), dtype=np.int32)[order]
        self.splitter = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Letters that the pattern library knows from a later Unicode version than the file's library.
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        later = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
        self.later = {ord(c): 0xFFFF for c in later}
        self.first_later = min(later, default="\U0010ffff")
        self.specials = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")")
        self.chunks: dict[str, bytes] = {"": b""}
        self.words: dict[str, bytes] = {}

    # --- merges ---------------------------------------------------------------------

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = self._key(left, right)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NO_RANK)

    def merge_rows(self, parts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge words of one length, given as rows of part ids: (row numbers, final parts)."""
        rows = np.arange(len(parts))
        ranks = self._lookup(parts[:, :-1], parts[:, 1:])
        while parts.shape[1] > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            live = best != NO_RANK
            if not live.all():
                yield rows[~live], parts[~live]
                rows, parts, ranks, at, best = rows[live], parts[live], ranks[live], at[live], best[live]
            if not len(rows):
                return
            each, length = np.arange(len(rows)), parts.shape[1]
            parts[each, at] = self.merged[best]
            places = np.arange(length - 1)
            parts = np.take_along_axis(parts, places + (places > at[:, None]), 1)
            places = np.arange(length - 2)
            ranks = np.take_along_axis(ranks, places + (places >= at[:, None]), 1)
            left = at > 0
            ranks[each[left], at[left] - 1] = self._lookup(parts[each[left], at[left] - 1], parts[each[left], at[left]])
            right = at < length - 2
            ranks[each[right], at[right]] = self._lookup(parts[each[right], at[right]], parts[each[right], at[right] + 1])
        yield rows, parts

    def merge_long(self, parts: list[int]) -> list[int]:
        """The same merges for one long word, with a heap of (rank, place) over linked parts."""
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i) for i in range(len(parts) - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if parts[i] < 0 or j >= len(parts) or self.ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i], parts[j], after[i] = int(self.merged[rank]), -1, after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < len(parts) and (r := self.ranks.get((parts[a], parts[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def learn_words(self, words: list[str]) -> None:
        """Put the ids of new words into the cache."""
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w) if w.isascii() else len(w.encode()), []).append(w)
        for length, group in by_length.items():
            codes = np.frombuffer("".join(group).encode(), np.uint8).reshape(len(group), length)
            parts = self.inside[codes]
            parts[:, -1] = self.ending[codes[:, -1]]
            if length > SHORT:
                for w, row in zip(group, parts):
                    self.words[w] = np.array(self.merge_long(row.tolist()), "<u4").tobytes()
                continue
            for rows, done in self.merge_rows(parts):
                data, step = done.astype("<u4").tobytes(), 4 * done.shape[1]
                self.words.update(zip(
                    [group[row] for row in rows.tolist()], [data[k : k + step] for k in range(0, len(data), step)]
                ))

    # --- texts ----------------------------------------------------------------------

    def cut(self, text: str) -> list[str]:
        """The words of normalised text."""
        if max(text) >= self.first_later:
            plain = text.translate(self.later)
            return [text[m.start() : m.end()] for m in self.splitter.finditer(plain)]
        return self.splitter.findall(text)

    def split(self, chunk: str) -> list[str | int]:
        """The words of a piece of text without spaces; special strings as their ids."""
        body = chunk[:-1] if chunk[-1] in ".,;:!?" else chunk
        if body.isalpha() and (body.isascii() or unicodedata.is_normalized("NFC", body) and "Σ" not in body):
            lowered = body.lower()
            if lowered.isalpha():
                return [lowered] if body is chunk else [lowered, chunk[-1]]
        out: list[str | int] = []
        for part in self.specials.split(chunk) if "<|" in chunk else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # One character at a time: a capital sigma has no final form here.
                out += self.cut(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def learn_chunks(self, chunks: set[str]) -> None:
        parts = [self.split(c) for c in chunks]
        self.learn_words([w for w in {w for p in parts for w in p}.difference(self.words) if isinstance(w, str)])
        words, known = self.words, self.chunks
        for c, p in zip(chunks, parts):
            if len(p) == 1 and isinstance(p[0], str):
                known[c] = words[p[0]]
            else:
                known[c] = b"".join([words[w] if isinstance(w, str) else w.to_bytes(4, "little") for w in p])

    def encode_slice(self, texts: list[str]) -> list[bytes]:
        """The ids of texts of bounded total size, packed as little-endian 32-bit numbers."""
        if len(self.chunks) > CACHED or len(self.words) > CACHED:
            self.chunks, self.words = {"": b""}, {}
        split = [t.replace("\n", " ").split(" ") for t in texts]
        self.learn_chunks(set().union(*split).difference(self.chunks))
        get = self.chunks.__getitem__
        return [b"".join(map(get, chunks)) for chunks in split]

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text cut at spaces into pieces of about ``size`` characters."""
    at = 0
    while len(text) - at > size:
        end = text.find(" ", at + size)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:] if at else text


def encode_all(vocabulary: Vocabulary, texts: Iterator[str | None]) -> Iterator[bytes]:
    """The ids of each text in turn; short texts are encoded together, long ones in slices."""
    waiting: list[str] = []
    size = 0
    for text in texts:
        text = text or ""
        if size + len(text) > SLICE and waiting:
            yield from vocabulary.encode_slice(waiting)
            waiting, size = [], 0
        if len(text) > SLICE:
            yield b"".join(vocabulary.encode_slice([piece])[0] for piece in slices(text))
        else:
            waiting.append(text)
            size += len(text)
    if waiting:
        yield from vocabulary.encode_slice(waiting)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary_at(path: str) -> Vocabulary:
    """The vocabulary of a file, read once in each worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def round_trip(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decode: bool = True) -> DataFrame:
    """Columns ``keep``, then ``n_tokens``, ``ids`` (packed as little-endian 32-bit numbers) and ``decoded``.

    ``path`` is the vocabulary file's place on every executor.
    """
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    added += [T.StructField("decoded", T.StringType())] if decode else []
    keep = [c for c in df.columns if c != text] if keep is None else keep
    keep = [c for c in keep if c not in [f.name for f in added]]
    taken, at_text = carried(df, keep, text)
    names = [f"__kept{i}" for i in range(len(keep))]
    schema = T.StructType([*taken.schema.fields[: len(keep)], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = vocabulary_at(path)

        def rows_of(batch: pa.RecordBatch, start: int, ids: list[bytes]) -> pa.RecordBatch:
            columns = [batch.column(i).slice(start, len(ids)) for i in range(len(names))]
            columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            columns += [pa.array([vocabulary.decode(x) for x in ids], pa.string())] if decode else []
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            start, done, size = 0, [], 0
            for ids in encode_all(vocabulary, (x.as_py() for x in batch.column(at_text))):
                done.append(ids)
                size += len(ids)
                if size > 4 * SLICE:
                    yield rows_of(batch, start, done)
                    start, done, size = start + len(done), [], 0
            if done:
                yield rows_of(batch, start, done)

    return taken.mapInArrow(run, schema).select(
        *[F.col(n).alias(c) for n, c in zip(names, keep)], *[f.name for f in added]
    )
