"""Secret scan: fixed patterns, and a randomness test battery over every other long token.

Base spans are the leftmost non-overlapping matches of each fixed pattern that are long
enough.  Every other token of ``LEAST`` or more characters is cut at inner ``=`` and
tested, whole and cut at ``-_``, at ``+/`` and at all four; the cut with the least p-value
counts, its p-values times the number of cuts that differ.  The alphabet of a part is the
narrowest that fits (hex; letters, base32 and base36 of one case; alphanumeric, base64 or
base64url), and on the symbol numbers:

* a chi-squared test of uniform use of the alphabet,
* a Wald-Wolfowitz runs test around the median, and
* a lag-1 serial correlation test

must all accept randomness.  For the tokens that pass, a p-value says how likely text
written by people looks at least as random: its collisions of symbols and its changes
between letter case and digits, against the rates of ``NATURAL``, combined by Fisher's
method.  Benjamini-Hochberg over all tokens of the corpus in one band of lengths keeps
the expected share of wrong spans of that band at ``RATE``; short tokens, of which there
are many, do not weaken or ride on the long ones.  p-values are rounded up to steps of
a hundredth of a decade, so the corpus is summed up in a table of bounded size.

Positions are code points, ends exclusive.  Defined cases: null text is empty; equal
rows get equal results (each counts as its own tokens); spans that touch a base span are
not added; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

# The kinds in their order, their patterns and least lengths.
KINDS = ["assign", "access", "hex", "random"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32

LEAST = 16
LONG = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
SEGMENT = re.compile(r"[A-Za-z0-9+/_-]+")
# The ways to cut a segment into parts: whole, and at separators that are foreign to an alphabet.
CUTS = [SEGMENT, re.compile(r"[A-Za-z0-9+/]+"), re.compile(r"[A-Za-z0-9_-]+"), re.compile(r"[A-Za-z0-9]+")]
HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)

# Symbols of each alphabet in their order, and the rates of people's text in it: the
# chance that two symbols are equal, its spread per symbol, and of a change of class.
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABETS = {
    "hex": DIGITS + "abcdef", "letters": LOWER, "base32": LOWER + "234567", "base36": DIGITS + LOWER,
    "alphanumeric": UPPER + LOWER + DIGITS, "base64": UPPER + LOWER + DIGITS + "+/", "base64url": UPPER + LOWER + DIGITS + "-_",
}
# Alphabets of one case, numbered by the lower-case letter.
ONE_CASE = {"hex", "letters", "base32", "base36"}
NATURAL = {
    "hex": (0.12, 0.004, 0.10), "letters": (0.066, 0.0012, 0.10), "base32": (0.066, 0.0012, 0.10), "base36": (0.066, 0.0012, 0.10),
    "alphanumeric": (0.066, 0.0012, 0.35), "base64": (0.066, 0.0012, 0.35), "base64url": (0.066, 0.0012, 0.35),
}
ACCEPT = 0.001
RATE = 0.01
BANDS = [16, 20, 24, 32, 48, 80]
LEVELS = 3000

_NORMAL = NormalDist()


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def alphabet_of(token: str) -> str | None:
    """The narrowest alphabet of a token without its padding; None for digits alone."""
    if token.isdigit():
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", token):
        return "hex"
    if re.fullmatch(r"[a-z]+|[A-Z]+", token):
        return "letters"
    if re.fullmatch(r"[a-z2-7]+|[A-Z2-7]+", token):
        return "base32"
    if re.fullmatch(r"[a-z0-9]+|[A-Z0-9]+", token):
        return "base36"
    if token.isalnum():
        return "alphanumeric"
    if re.fullmatch(r"[A-Za-z0-9+/]+", token):
        return "base64"
    return "base64url" if re.fullmatch(r"[A-Za-z0-9_-]+", token) else None


def uniformity(counts: list[int], n: int, k: int) -> float:
    """Upper tail of the chi-squared statistic, by its exact mean and variance under uniform use."""
    x = k / n * sum(c * c for c in counts) - n
    mean, variance = k - 1, 2 * (k - 1) * (n - 1) / n
    df = 2 * mean * mean / variance
    z = ((max(x, 0) / mean) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    return 1 - _NORMAL.cdf(z)


def runs(numbers: list[int]) -> float:
    """Two-sided Wald-Wolfowitz test of runs above and below the middle of the order."""
    middle = sorted(numbers)[len(numbers) // 2]
    above = [x >= middle for x in numbers]
    n1, n2 = sum(above), len(above) - sum(above)
    if not n1 or not n2:
        return 0.0
    found = 1 + sum(a != b for a, b in zip(above, above[1:]))
    n = n1 + n2
    mean = 1 + 2 * n1 * n2 / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return two_sided((found - mean) / math.sqrt(variance)) if variance > 0 else 1.0


def serial(numbers: list[int]) -> float:
    """Two-sided test of the correlation of neighbours."""
    n = len(numbers)
    mean = sum(numbers) / n
    spread = sum((x - mean) ** 2 for x in numbers)
    if not spread:
        return 0.0
    r = sum((a - mean) * (b - mean) for a, b in zip(numbers, numbers[1:])) / spread
    return two_sided((r + 1 / n) * math.sqrt(n))


def binomial_tail(n: int, least: int, p: float) -> float:
    """The chance of ``least`` or more out of ``n``."""
    return min(1.0, sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(least, n + 1))) if n <= 400 else (
        1 - _NORMAL.cdf((least - 0.5 - n * p) / math.sqrt(n * p * (1 - p)))
    )


def symbol_class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def natural_p(token: str, counts: list[int], alphabet: str) -> float:
    """How likely people's text of this length looks at least as random."""
    n = len(token)
    rate, spread, change = NATURAL[alphabet]
    collisions = sum(c * (c - 1) for c in counts) / (n * (n - 1))
    deviation = math.sqrt(4 * spread / n + 2 * rate * (1 - rate) / (n * (n - 1)))
    even = max(_NORMAL.cdf((collisions - rate) / deviation), 1e-300)
    classes = [symbol_class(c) for c in token]
    changes = sum(a != b for a, b in zip(classes, classes[1:]))
    mixed = max(binomial_tail(n - 1, changes, change), 1e-300)
    product = even * mixed
    return min(1.0, product * (1 - math.log(product))) if product > 0 else 1e-300


def battery(token: str) -> tuple[str, float] | None:
    """The alphabet and p-value of a token; a token that a randomness test refuses has p = 1."""
    body = token.rstrip("=")
    name = alphabet_of(body)
    if name is None or len(body) < LEAST:
        return None
    symbols = ALPHABETS[name]
    place = {c: i for i, c in enumerate(symbols)}
    numbers = [place[c] for c in (body.lower() if name in ONE_CASE else body)]
    counts = [0] * len(symbols)
    for x in numbers:
        counts[x] += 1
    tests = (uniformity(counts, len(body), len(symbols)), runs(numbers), serial(numbers))
    return name, natural_p(body, counts, name) if 3 * min(tests) >= ACCEPT else 1.0


def level_of(p: float) -> int:
    """Hundredths of a decade below 1, rounded so that p is never understated."""
    return min(LEVELS, max(0, math.floor(-100 * math.log10(max(p, 1e-300)) + 1e-9)))


def band_of(length: int) -> int:
    return max(b for b in BANDS if b <= length)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    out = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    for token in LONG.finditer(text):
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text, token.start(), token.end())]
    return sorted(out)


def tested_tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """(start, end, alphabet, band, level) of the parts of long tokens that touch no base span."""
    out = []
    for m in LONG.finditer(text):
        for segment in SEGMENT.finditer(text, m.start(), m.end()):
            if segment.end() - segment.start() >= LEAST:
                out += best_cut(text, segment.start(), segment.end(), m.end(), base)
    return out


def best_cut(text: str, start: int, end: int, padded: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, int, int]]:
    """The tested parts of the cut of a segment whose most random part is the most random of all; what pads the token up to ``padded`` is its last part's."""
    cuts = {tuple((p.start(), p.end()) for p in cut.finditer(text, start, end) if p.end() - p.start() >= LEAST) for cut in CUTS}
    tried = []
    for cut in sorted(c for c in cuts if c):
        parts = []
        for a, b in cut:
            stop = padded if not text[b:padded].strip("=") else b
            if not any(x < stop and a < y for x, _, y in base) and (found := battery(text[a:b])):
                parts.append((found[1], a, stop, found[0], band_of(b - a)))
        if parts:
            tried.append(parts)
    if not tried:
        return []
    chosen = min(tried, key=lambda parts: (min(parts), parts))
    return [(a, b, name, band, level_of(min(1.0, p * len(tried)))) for p, a, b, name, band in chosen]


SPAN = "start long, kind int, end long"
TOKEN = "start long, end long, alphabet string, band int, level int"


def scan(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, the ``base`` spans and the ``tested`` tokens of each whole text."""
    kept = [F.col(f"`{c}`").alias(f"__kept{i}") for i, c in enumerate(keep)]
    taken = docs.select(*kept, F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([
        *taken.schema.fields[: len(keep)],
        T.StructField("base", T.ArrayType(T.StructType.fromDDL(SPAN))),
        T.StructField("tested", T.ArrayType(T.StructType.fromDDL(TOKEN))),
    ])
    spans = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    tokens = pa.list_(pa.struct([
        ("start", pa.int64()), ("end", pa.int64()), ("alphabet", pa.string()), ("band", pa.int32()), ("level", pa.int32()),
    ]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, tested = [], []
            for value in batch.column(len(keep)):
                said = value.as_py() or ""
                found = base_spans(said)
                base.append([dict(zip(("start", "kind", "end"), x)) for x in found])
                tested.append([dict(zip(("start", "end", "alphabet", "band", "level"), x)) for x in tested_tokens(said, found)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(base, spans), pa.array(tested, tokens)], names=schema.names
            )

    return taken.mapInArrow(run, schema).select(*[F.col(f"__kept{i}").alias(c) for i, c in enumerate(keep)], "base", "tested")


def discovery_levels(scanned: DataFrame, rate: float = RATE) -> dict[int, int]:
    """Per band, the level from which tokens are reported (Benjamini-Hochberg over all tokens of the band)."""
    token = scanned.select(F.explode("tested").alias("t"))
    counted = token.groupBy("t.band", "t.level").count().collect()
    out = {}
    for band in BANDS:
        levels = sorted(((r["level"], r["count"]) for r in counted if r["band"] == band), reverse=True)
        total, above, least = sum(n for _, n in levels), 0, LEVELS + 1
        for level, n in levels:
            above += n
            if 10 ** (-level / 100) <= rate * above / total:
                least = level
        out[band] = least
    return out


def find_secrets(docs: DataFrame, keep: list[str], text: str = "text", rate: float = RATE) -> DataFrame:
    """Columns ``keep``, ``base`` spans and all ``spans`` (start, kind number, end), in order."""
    scanned = stored(scan(docs, keep, text))
    least = discovery_levels(scanned, rate)
    return scanned.select(
        *[F.col(f"`{c}`") for c in keep], "base",
        F.array_sort(F.concat("base", F.transform(F.filter("tested", _reported(least)), lambda t: F.struct(
            t["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), t["end"].alias("end"),
        )))).alias("spans"),
    )


def _reported(least: dict[int, int]):
    def test(token: Column) -> Column:
        out = F.lit(False)
        for band, level in least.items():
            out = out | ((token["band"] == band) & (token["level"] >= level))
        return out

    return test


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string")
    )), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
