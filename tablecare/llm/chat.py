"""Chat formatting: schema fingerprints choose declarative mappings to canonical turns.

Each ``Layout`` names the nested field paths it needs.  Its fingerprint is a hash of
those sorted paths.  A table (``canonical_turns``) is matched by the paths of its
schema, a column of JSON records (``canonical_records``) row by row by the paths found
in each record; a layout fits when the hash of the paths it shares with the input is
its own fingerprint, so unknown extra fields never hide a layout.  The first fitting
layout of ``LAYOUTS`` wins.  Layouts are data: a list field with role and text paths,
a fixed sequence of (role, path), or one row per turn.

``format_turns`` writes canonical turns with a ``Template`` and the spans of the loss
mask; ``read_turns`` and ``loss_text`` get them back from the written string alone.

Control strings in roles and texts are escaped reversibly: behind the first character
of a control string goes one more escape character than was there before, so no
control string is left in a text and taking one away restores it.

Everything is DataFrame functions.  Defined cases: null role and null text are empty;
turns with equal turn number are ordered by role, then text; a null turn number comes
first; a null conversation id is a conversation of its own; records that fit no layout
give null turns; an empty table gives an empty result.  A conversation is one row of
the result, so its turns must fit in a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """``rows``: (id, turn, role, text) fields; ``items``: (list, role, text) paths; ``steps``: (role, path) pairs."""

    name: str
    rows: tuple[str, str, str, str] | None = None
    items: tuple[str, str, str] | None = None
    steps: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict, hash=False)

    @property
    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.items:
            return sorted([self.items[0], f"{self.items[0]}[].{self.items[1]}", f"{self.items[0]}[].{self.items[2]}"])
        return sorted(path for _, path in self.steps)


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = [
    Layout("turn rows", rows=("conv_id", "turn", "role", "text")),
    Layout("message list", items=("messages", "role", "content")),
    Layout("message texts", items=("messages", "role", "text")),
    Layout("speaker list", items=("conversations", "from", "value"), roles=SPEAKERS),
    Layout("system prompt response", steps=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt response", steps=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt completion", steps=(("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction input output", steps=(("system", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("instruction output", steps=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction response", steps=(("user", "instruction"), ("assistant", "response"))),
    Layout("question answer", steps=(("user", "question"), ("assistant", "answer"))),
    Layout("nested example", steps=(("user", "data.prompt"), ("assistant", "data.response"))),
]


@dataclass(frozen=True)
class Template:
    """A turn is ``open`` role ``middle`` text ``close``; ``controls`` are never left in a role or text.

    A control string's first character must not come again inside it.
    """

    open: str = "<s>[INST] "
    middle: str = " [/INST]\n"
    close: str = "</s>\n"
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]")
    escape: str = "~"
    trained_role: str = "assistant"


TEMPLATE = Template()


# --- fingerprints -------------------------------------------------------------------


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """The nested field paths of a type; list elements are written ``[]``."""
    if isinstance(kind, T.StructType):
        out = []
        for f in kind.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            out += [path, *schema_paths(f.dataType, path)]
        return out
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return []


# The parts of a JSON text that make its structure: keys, other strings, brackets.
_TOKEN = r'"(?:[^"\\]|\\.)*"(?:\s*:)?|[\{\}\[\]]'


def record_paths(record: Column) -> Column:
    """The nested field paths of one JSON record, however deep, as an array.

    One walk over keys and brackets: the stack holds the path of every open object or
    list, ``held`` the path of the key whose value comes next.
    """
    text = "string"
    state = F.struct(
        F.array().cast("array<string>").alias("stack"), F.lit(None).cast(text).alias("held"), F.array().cast("array<string>").alias("paths")
    )

    def walk(s: Column, token: Column) -> Column:
        top = F.coalesce(F.get(s["stack"], F.size(s["stack"]) - 1), F.lit(""))
        name = F.regexp_extract(token, r'(?s)^"(.*)"\s*:$', 1)
        path = F.when(top == "", name).otherwise(F.concat(top, F.lit("."), name))
        inner = F.coalesce(s["held"], top)
        none = F.lit(None).cast(text)

        def to(stack: Column, held: Column, paths: Column) -> Column:
            return F.struct(stack.alias("stack"), held.alias("held"), paths.alias("paths"))

        return (
            F.when(token.endswith(":"), to(s["stack"], path, F.array_append(s["paths"], path)))
            .when(token == "{", to(F.array_append(s["stack"], inner), none, s["paths"]))
            .when(token == "[", to(F.array_append(s["stack"], F.concat(inner, F.lit("[]"))), none, s["paths"]))
            .when(token.isin("}", "]"), to(F.slice(s["stack"], 1, F.greatest(F.size(s["stack"]) - 1, F.lit(0))), none, s["paths"]))
            .otherwise(to(s["stack"], none, s["paths"]))
        )

    tokens = F.coalesce(F.regexp_extract_all(record, F.lit(_TOKEN), F.lit(0)), F.array().cast("array<string>"))
    return F.array_distinct(F.aggregate(tokens, state, walk, lambda s: s["paths"]))


def fingerprint(paths: Column) -> Column:
    """A hash of the sorted distinct field paths."""
    return F.xxhash64(F.array_join(F.array_sort(F.array_distinct(paths)), "\n"))


def fits(paths: Column, layout: Layout) -> Column:
    """Whether the paths shared with the layout have the layout's fingerprint."""
    wanted = F.array(*[F.lit(p) for p in layout.paths])
    return fingerprint(F.array_intersect(paths, wanted)) == fingerprint(wanted)


def layout_of(df: DataFrame, layouts: list[Layout] = LAYOUTS) -> Layout:
    """The first layout whose fingerprint the table's schema has."""
    paths = F.array(F.lit(""), *[F.lit(p) for p in schema_paths(df.schema)])
    chosen = F.coalesce(*[F.when(fits(paths, x), F.lit(i)) for i, x in enumerate(layouts)])
    at = df.sparkSession.range(1).select(chosen).head()[0]
    if at is None:
        raise ValueError(f"no layout has the field paths {schema_paths(df.schema)}")
    return layouts[at]


# --- mappings -----------------------------------------------------------------------


def _turn(role: Column, text: Column, roles: dict[str, str]) -> Column:
    name = F.coalesce(role.cast("string"), F.lit(""))
    if roles:
        mapping = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
        name = F.coalesce(mapping[name], name)
    return F.struct(name.alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def canonical_turns(df: DataFrame, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """One row per conversation with ``turns``; the mapping is chosen by the schema's fingerprint."""
    layout = layout_of(df, layouts)
    if layout.rows:
        key, turn, role, text = (F.col(f"`{c}`") for c in layout.rows)
        said = _turn(role, text, layout.roles)
        row = F.struct(turn.alias("turn"), said["role"].alias("role"), said["text"].alias("text"))
        grouped = df.groupBy(key.alias(layout.rows[0])).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
        return grouped.select(layout.rows[0], F.transform("__rows", lambda r: F.struct(r["role"], r["text"])).cast(TURNS).alias("turns"))
    if layout.items:
        held, role, text = layout.items
        turns = F.transform(F.col(held), lambda m: _turn(m[role], m[text], layout.roles))
    else:
        turns = F.array(*[_turn(F.lit(r), F.col(p), layout.roles) for r, p in layout.steps])
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != "turns"], turns.cast(TURNS).alias("turns"))


def canonical_records(df: DataFrame, column: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``df`` with ``layout`` and ``turns`` read from JSON records of any mixture of layouts."""
    record = F.col(f"`{column}`")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("layout", "turns", "__paths")]
    found = df.select(*kept, record_paths(record).alias("__paths"))

    def value(path: str) -> Column:
        return F.get_json_object(record, "$." + path)

    def read(layout: Layout) -> Column:
        if layout.items:
            held, role, text = layout.items
            items = F.from_json(value(held), f"array<struct<`{role}`:string,`{text}`:string>>")
            return F.transform(items, lambda m: _turn(m[role], m[text], layout.roles)).cast(TURNS)
        return F.array(*[_turn(F.lit(r), value(p), layout.roles) for r, p in layout.steps]).cast(TURNS)

    usable = [x for x in layouts if not x.rows]
    chosen = F.coalesce(*[F.when(fits(F.col("__paths"), x), F.lit(x.name)) for x in usable])
    turns = F.coalesce(*[F.when(F.col("layout") == x.name, read(x)) for x in usable])
    return found.withColumn("layout", chosen).withColumn("turns", turns).drop("__paths")


# --- template -----------------------------------------------------------------------


def escaped(text: Column, template: Template = TEMPLATE) -> Column:
    for control in template.controls:
        first, rest = control[0], control[1:]
        pattern = f"{re.escape(first)}({re.escape(template.escape)}*){re.escape(rest)}"
        text = F.regexp_replace(text, pattern, f"{first}{template.escape}$1{rest}")
    return text


def unescaped(text: Column, template: Template = TEMPLATE) -> Column:
    for control in template.controls:
        first, rest = control[0], control[1:]
        mark = re.escape(template.escape)
        text = F.regexp_replace(text, f"{re.escape(first)}{mark}({mark}*){re.escape(rest)}", f"{first}$1{rest}")
    return text


def format_turns(df: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Add ``formatted`` and ``loss``: the spans (start, length in code points) that are trained on."""
    pieces = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(template.open), escaped(t["role"], template), F.lit(template.middle)).alias("head"),
        escaped(t["text"], template).alias("body"), (t["role"] == template.trained_role).alias("trained"),
    ))
    spans = F.aggregate(
        "__pieces",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda done, p: F.struct(
            (done["at"] + F.length(p["head"]) + F.length(p["body"]) + F.lit(len(template.close))).alias("at"),
            F.when(p["trained"], F.concat(done["spans"], F.array(F.struct(
                (done["at"] + F.length(p["head"])).alias("start"), F.length(p["body"]).alias("length"),
            )))).otherwise(done["spans"]).alias("spans"),
        ),
        lambda done: done["spans"],
    )
    joined = F.array_join(F.transform("__pieces", lambda p: F.concat(p["head"], p["body"], F.lit(template.close))), "")
    return df.withColumn("__pieces", pieces).withColumn("formatted", joined).withColumn("loss", spans).drop("__pieces")


def read_turns(formatted: Column, template: Template = TEMPLATE) -> Column:
    """The turns of a formatted string, unescaped."""
    parts = F.split(formatted, re.escape(template.close))
    written = F.slice(parts, 1, F.size(parts) - 1)

    def turn(part: Column) -> Column:
        halves = F.split(F.substring(part, len(template.open) + 1, 1 << 30), re.escape(template.middle), 2)
        return F.struct(unescaped(halves[0], template).alias("role"), unescaped(halves[1], template).alias("text"))

    return F.transform(written, turn)


def loss_text(formatted: Column, loss: Column, template: Template = TEMPLATE) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(
        loss, lambda s: unescaped(formatted.substr(s["start"] + 1, s["length"]), template)
    ), "")
