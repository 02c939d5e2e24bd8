"""Rules that read column names; these run on the schema, not on rows."""

from __future__ import annotations

import re
import string

# Words that make a column an identifier, and the name patterns
# of the impossible-value rules.
ID_WORDS = {"id", "ids", "number", "no", "num"}
NEVER_NEGATIVE = re.compile(
    r"\b(age|count|qty|quantity|dose|amount|price|cost|weight|height|duration|days|mg|ml|number|num|total|score)\b",
    re.I,
)
AGE_NAME = re.compile(r"\bage\b", re.I)
START_NAME = re.compile(r"(start|admit|admission|onset|begin|from)", re.I)
END_NAME = re.compile(r"(end|discharge|resolve|resolved|stop|finish|to)", re.I)


def name_key(name: str | None) -> str:
    """Lower-case letters and digits only (F2 on a name)."""
    return re.sub(r"[^a-z0-9]", "", (name or "").lower())


def term_key(term: str) -> str:
    """The loose key of a defined term: F2 without one trailing s."""
    return name_key(term).removesuffix("s")


def match_name(recorded: str | None, names: list[str]) -> str | None:
    """The current spelling of a recorded column name."""
    wanted = name_key(recorded)
    return next((n for n in names if wanted and name_key(n) == wanted), None)


def id_role(name: str | None) -> str | None:
    """``encounter``, ``patient`` or None, from the words of a column name."""
    spaced = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name or "").lower()
    words = re.findall(r"[a-z0-9]+", spaced)
    identifies = not ID_WORDS.isdisjoint(words)
    if "csn" in words or ("encounter" in words and identifies):
        return "encounter"
    record = any(pair == ("medical", "record") for pair in zip(words, words[1:]))
    if "mrn" in words or record or ("patient" in words and identifies):
        return "patient"
    return None


def column_letter(index: int) -> str:
    """0 to A, 25 to Z, 26 to AA."""
    name = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        name = string.ascii_uppercase[rest] + name
    return name


def unique_names(raw: list[str | None]) -> list[str]:
    """Blank names become ``Column <letter>``; repeats become ``name (2)`` and on."""
    taken: set[str] = set()
    for i, name in enumerate(raw):
        base = (name or "").strip() or f"Column {column_letter(i)}"
        candidate, n = base, 2
        while candidate in taken:
            candidate, n = f"{base} ({n})", n + 1
        taken.add(candidate)
        raw = [*raw[:i], candidate, *raw[i + 1 :]]
    return raw


def safe_table_names(names: list[str]) -> list[str]:
    """Unique names of at most 31 characters without ``\\ / ? * [ ] :``."""
    out: list[str] = []
    for name in names:
        base = re.sub(r"[\\/?*\[\]:]", " ", name or "Sheet")[:31].strip() or "Sheet"
        candidate, n = base, 2
        while candidate in out:
            suffix = f" ({n})"
            candidate, n = base[: 31 - len(suffix)] + suffix, n + 1
        out.append(candidate)
    return out
