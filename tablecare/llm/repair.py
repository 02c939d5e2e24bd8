"""Repair of conversation structure by a square-root checkpointed dynamic programme.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their initials.  A row may be
Kept (free), Reroled to user or assistant (1) or Deleted (2), and an empty user or
assistant row Inserted anywhere (5).  Blank and repeated rows must be deleted; a
truncated row that stays costs 5 more.  Of the cheapest repairs the one whose edits'
initials are least in ASCII is taken.

What may come next depends on one of four states (nothing yet, after system, after user,
after assistant), so a place in a conversation has a vector of four costs: the least
to finish from there.  The vectors are computed backward.  Only those at checkpoints, a
square root of the rows apart, are stored; walking forward, the block between two
checkpoints is computed again and the least tight edit is emitted row by row.

A conversation of any length is shared out.  Its rows, without their texts, are sorted
over all partitions and cut into segments of at most ``SEGMENT`` rows.  Most conversations
lie in one segment.  For the others, segments give min-plus matrices of 4 x 4
costs, the vectors at their ends follow from these matrices alone, every segment is walked
from each state it may begin in, and the chain of states picks one walk of each.  So a task
holds one segment's codes, or 16 numbers per segment of one conversation.

Equal rows (turn, role, text) of a conversation are one counted row until the end.  Texts
are known by their SHA-256 and move once to meet their edits, and once more if they are
written out in order.

Defined cases: a null role or text is one space; null turns come first; rows of one turn
go by role, then by the digest of the text; a null conversation key is a conversation; a
role that begins with none of s, u, a (the empty one too) cannot be kept; empty tables
give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import placed, stored

SEGMENT = 1 << 16
DELETE, INSERT, REROLE, CUT = 2, 5, 1, 5
NOWHERE = 1 << 60

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT = (2, 2, 3, 2)
ADDED = ("user", "user", "assistant", "user")
KEEP = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
END = (0, 2 * INSERT, INSERT, 0)
FINE, SHORT, GONE = 0, 1, 2
LEGAL = {"su", "ua", "au"}

Row = tuple[str, int, int]  # role initial, kind, copies


def vector_before(row: Row, after: tuple[int, ...]) -> tuple[int, ...]:
    """The least cost to finish from before a row in each state, given that from after it.

    Further copies of a row are always deleted, and right after it.
    """
    initial, kind, copies = row
    if kind == GONE:
        best = [DELETE * copies + c for c in after]
    else:
        stays, rest, kept = CUT if kind == SHORT else 0, DELETE * (copies - 1), KEEP.get(initial)
        best = []
        for q in range(4):
            cost = min(DELETE + after[q], stays + REROLE + after[NEXT[q]])
            if kept and kept[q] is not None:
                cost = min(cost, stays + after[kept[q]])
            best.append(rest + cost)
    # At most two rows are worth inserting in one place.
    return tuple(min(best[q], INSERT + best[n], 2 * INSERT + best[NEXT[n]]) for q, n in enumerate(NEXT))


@dataclass
class Walk:
    """The edits of one segment from one state: per row, the initials and the roles they give."""

    state: int
    cost: int
    edits: list[str]
    roles: list[list[str]]

    def insert(self, edits: str, roles: list[str]) -> tuple[str, list[str]]:
        roles.append(ADDED[self.state])
        self.state, self.cost = NEXT[self.state], self.cost + INSERT
        return edits + "I", roles

    def step(self, row: Row, before: tuple[int, ...], after: tuple[int, ...]) -> None:
        """The least tight edits over one row: D before I before K before R."""
        initial, kind, copies = row
        rest = DELETE * (copies - 1)
        stays, kept = CUT if kind == SHORT else 0, KEEP.get(initial)
        edits, roles = "", []
        while True:
            q, left = self.state, before[self.state]
            if left == DELETE + rest + after[q]:
                edit, cost = "D", DELETE
            elif left == INSERT + before[NEXT[q]]:
                edits, roles = self.insert(edits, roles)
                continue
            elif kept and kept[q] is not None and left == stays + rest + after[kept[q]]:
                edit, cost, self.state = "K", stays, kept[q]
                roles.append("")
            else:
                edit, cost, self.state = "R", stays + REROLE, NEXT[q]
                roles.append(ADDED[q])
            self.edits.append(edits + edit + "D" * (copies - 1))
            self.roles.append(roles)
            self.cost += cost + rest
            return

    def finish(self) -> None:
        """Insert what the end of the conversation still asks for."""
        while self.state in (1, 2):
            self.edits[-1], self.roles[-1] = self.insert(self.edits[-1], self.roles[-1])


def walks(rows: list[Row], after: tuple[int, ...], states: tuple[int, ...]) -> list[Walk]:
    """The walk over a segment from each of ``states``; ``after`` is the vector at its end."""
    apart = isqrt(len(rows)) + 1
    checkpoints, vector = {}, after
    for i in range(len(rows) - 1, -1, -1):
        if (i + 1) % apart == 0 or i + 1 == len(rows):
            checkpoints[i // apart] = vector
        vector = vector_before(rows[i], vector)
    found = [Walk(q, 0, [], []) for q in states]
    for block in range((len(rows) + apart - 1) // apart):
        part = rows[block * apart : (block + 1) * apart]
        vectors = [checkpoints[block]]
        for row in reversed(part):
            vectors.append(vector_before(row, vectors[-1]))
        vectors.reverse()
        for walk in found:
            for row, before, behind in zip(part, vectors, vectors[1:]):
                walk.step(row, before, behind)
    return found


def matrix(rows: list[Row]) -> list[int]:
    """The least cost over a segment from each state to each state, row by row."""
    columns = []
    for out in range(4):
        vector = tuple(0 if q == out else NOWHERE for q in range(4))
        for row in reversed(rows):
            vector = vector_before(row, vector)
        columns.append(vector)
    return [columns[out][q] for q in range(4) for out in range(4)]


def vectors_at_ends(matrices: list[list[int]]) -> list[tuple[int, ...]]:
    """The vector at the end of each segment of one conversation, from the matrices of those behind it."""
    vector, out = END, []
    for m in reversed(matrices):
        out.append(vector)
        vector = tuple(min(m[4 * q + r] + vector[r] for r in range(4)) for q in range(4))
    return out[::-1]


# --- on Spark -----------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"
_WALK = "struct<state int, cost bigint, edits array<string>, roles array<array<string>>>"


def _same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[f"__{k}"])
    return out


def _met(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on keys that may be null; the keys stay once."""
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    out = a.join(other, _same(a, other, keys), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__{k}" for k in keys])


def judged_rows(turns: DataFrame) -> DataFrame:
    """Distinct rows (conv, turn, role, digest) in order, each with ``n`` copies, its first fault and its place; stored."""
    left = F.rtrim(F.col("text"), F.lit(WHITE))
    known = turns.select(
        "conv", "turn", "role", F.sha2("text", 256).alias("digest"), (left == "").alias("blank"),
        (~F.substring(left, -1, 1).isin(".", "!", "?")).alias("cut"),
    )
    counted = known.groupBy("conv", "turn", "role", "digest").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("blank").alias("blank"), F.bool_or("cut").alias("cut")
    )
    counted = stored(counted)
    earliest = counted.groupBy("conv", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"), F.count(F.lit(1)).alias("turns")
    ).filter("turns > 1").drop("turns")
    rows = _met(counted, earliest, ["conv", "role", "digest"], "left")
    later = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    fault = (
        F.when(F.col("blank"), "blank").when(later, "duplicate").when(F.col("cut"), "truncated").otherwise("")
    )
    rows = rows.select("conv", "turn", "role", "digest", "n", fault.alias("fault"))
    return placed(rows, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")])


def _segments(rows: DataFrame, size: int) -> DataFrame:
    kind = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", SHORT).otherwise(FINE)
    one = F.struct(F.col("__pos").alias("pos"), F.substring("role", 1, 1).alias("initial"), kind.cast("int").alias("kind"), "n")
    block = F.floor(F.col("__pos") / size).alias("block")
    return rows.groupBy("conv", F.col("__part").alias("part"), block).agg(F.sort_array(F.collect_list(one)).alias("rows"))


def _coded(rows: list[dict]) -> list[Row]:
    return [(r["initial"], r["kind"], r["n"]) for r in rows]


def _illegal(rows: list[Row]) -> int:
    inside = sum(r[2] - 1 for r in rows)
    return inside + sum(a[0] + b[0] not in LEGAL for a, b in zip(rows, rows[1:]))


def _over_rows(df: DataFrame, schema: str, make) -> DataFrame:
    """One row of ``schema`` per row of ``df``, made in Python from a dict of it."""
    added = T.StructType.fromDDL(schema)
    whole, made_as = T.StructType([*df.schema.fields, *added.fields]), to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = pa.RecordBatch.from_pylist([make(r) for r in some.to_pylist()], schema=made_as)
                yield pa.RecordBatch.from_arrays([*some.columns, *made.columns], names=whole.names)

    return df.mapInArrow(run, whole)


def _finished(rows: list[dict]) -> dict:
    coded = _coded(rows)
    walk = walks(coded, END, (0,))[0]
    walk.finish()
    return {"walk": walk.__dict__, "illegal": _illegal(coded)}


def _whole_walks(single: DataFrame) -> DataFrame:
    return _over_rows(single, f"walk {_WALK}, illegal bigint", lambda r: _finished(r["rows"]))


def _chained_walks(cut: DataFrame) -> DataFrame:
    """The walks of conversations that lie in several segments."""
    at = F.struct("part", "block")
    priced = _over_rows(cut, "costs array<bigint>", lambda r: {"costs": matrix(_coded(r["rows"]))}).select("conv", "part", "block", "costs")
    listed = priced.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct(at.alias("at"), "costs"))).alias("parts"))
    ends = _over_rows(
        listed, "ends array<array<bigint>>", lambda r: {"ends": [list(v) for v in vectors_at_ends([p["costs"] for p in r["parts"]])]}
    )
    ends = ends.select("conv", F.posexplode(F.arrays_zip("parts", "ends")).alias("number", "end"), F.size("parts").alias("of"))
    ends = ends.select("conv", F.col("end.parts.at.part").alias("part"), F.col("end.parts.at.block").alias("block"), F.col("end.ends").alias("after"), "number", "of")

    def four(r: dict) -> dict:
        rows = _coded(r["rows"])
        found = walks(rows, tuple(r["after"]), (0,) if r["number"] == 0 else (0, 1, 2, 3))
        if r["number"] == r["of"] - 1:
            for walk in found:
                walk.finish()
        return {"tries": [w.__dict__ for w in found], "inside": _illegal(rows), "first": rows[0][0], "last": rows[-1][0]}

    tried = stored(_over_rows(
        _met(cut, ends, ["conv", "part", "block"]), f"tries array<{_WALK}>, inside bigint, first string, last string", four
    ))

    def begun(r: dict) -> dict:
        state, said, out = 0, None, []
        for p in r["parts"]:
            out.append({"entry": state, "seam": int(said is not None and said + p["first"] not in LEGAL)})
            state, said = p["outs"][state], p["last"]
        return {"begins": out}

    outs = tried.select("conv", F.struct(at.alias("at"), F.col("tries.state").alias("outs"), "first", "last").alias("part"))
    listed = outs.groupBy("conv").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    begins = _over_rows(listed, "begins array<struct<entry int, seam bigint>>", begun)
    begins = begins.select("conv", F.explode(F.arrays_zip("parts", "begins")).alias("b"))
    begins = begins.select("conv", F.col("b.parts.at.part").alias("part"), F.col("b.parts.at.block").alias("block"), "b.begins.entry", "b.begins.seam")
    done = _met(tried, begins, ["conv", "part", "block"])
    return done.select("conv", "part", "block", "rows", F.col("tries")[F.col("entry")].alias("walk"), (F.col("inside") + F.col("seam")).alias("illegal"))


@dataclass
class Repair:
    """``summary``: one row per conversation; ``edits``: one per distinct row of it, in order of part and pos."""

    summary: DataFrame
    edits: DataFrame
    turns: DataFrame

    def texts(self) -> DataFrame:
        """The rows of ``edits`` that leave a turn, with their text."""
        said = self.turns.select("conv", "turn", "role", F.sha2("text", 256).alias("digest"), "text")
        return _met(said, self.edits.filter(F.size("roles") > 0), ["conv", "turn", "role", "digest"])

    def digests(self) -> DataFrame:
        """SHA-256 of the repaired turns of each conversation (``role:text``, newline-joined).

        A digest is read in order, so a conversation's texts stream through one task.
        """
        ordered = self.texts().select("conv", "part", "pos", "edits", "roles", "role", "text")
        ordered = ordered.repartition("conv").sortWithinPartitions("conv", "part", "pos")
        schema = T.StructType([ordered.schema["conv"], T.StructField("digest", T.StringType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, at, digest = None, None, None
            for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
                keys, digests = [], []
                for r in batch.to_pylist():
                    if digest is None or r["conv"] != conv:
                        if digest is not None:
                            keys.append(conv)
                            digests.append(digest.hexdigest())
                        conv, at, digest, begun = r["conv"], None, hashlib.sha256(), False
                    if at == (r["part"], r["pos"]):
                        continue  # a further copy of the row
                    at = (r["part"], r["pos"])
                    for role, said in repaired_turns(r):
                        digest.update(f"{chr(10) if begun else ''}{role}:{said}".encode())
                        begun = True
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("conv").type), pa.array(digests, pa.string())], names=schema.names)
            if digest is not None:
                yield pa.RecordBatch.from_arrays([pa.array([conv], batch.schema.field("conv").type), pa.array([digest.hexdigest()])], names=schema.names)

        return ordered.mapInArrow(run, schema)


def repaired_turns(row: dict) -> Iterator[tuple[str, str]]:
    """The turns that the edits of one row leave: its own and those inserted beside it."""
    roles = iter(row["roles"])
    for edit in row["edits"]:
        if edit == "I":
            yield next(roles), ""
        elif edit in "KR":
            yield next(roles) or row["role"], row["text"]


def repair(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> Repair:
    """Repair all conversations of ``turns``."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(" "))

    taken = turns.select(F.col(f"`{key}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), or_space(role).alias("role"), or_space(text).alias("text"))
    rows = judged_rows(taken)
    segments = stored(_segments(rows, segment))
    several = segments.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    cut = stored(_met(segments, several, ["conv"], "left_semi"))
    done = _whole_walks(_met(segments, several, ["conv"], "left_anti")).select("conv", "part", "block", "rows", "walk", "illegal")
    done = stored(done.unionByName(_chained_walks(cut)))

    edits = done.select("conv", "part", F.explode(F.arrays_zip(F.col("rows.pos").alias("pos"), F.col("walk.edits").alias("edits"), F.col("walk.roles").alias("roles"))).alias("e"))
    edits = edits.select(F.col("part").alias("__part"), F.col("e.pos").alias("__pos"), "e.edits", "e.roles")
    edits = rows.join(edits, ["__part", "__pos"]).withColumnsRenamed({"__part": "part", "__pos": "pos"})

    faults = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("n")).when(F.col("fault") == "blank", 0).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum((F.col("fault") == "truncated").cast("long")).alias("truncated"),
    )
    piece = F.struct("part", "block", F.array_join("walk.edits", "").alias("edits"))
    audits = done.groupBy("conv").agg(
        F.sum("illegal").alias("illegal"), F.sum("walk.cost").alias("cost"),
        F.array_join(F.sort_array(F.collect_list(piece))["edits"], "").alias("audit"),
    )
    return Repair(_met(faults, audits, ["conv"]), edits, taken)
