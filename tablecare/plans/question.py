"""Structured questions compiled to one DataFrame plan."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import match_name
from ..functions.numbers import round2
from ..functions.text import quoted
from ..operators import aggregate, ranking
from ..operators.cells import blank_of, key_of, number_of
from ..operators.conditions import Condition, folded, keep, keep_groups
from ..operators.quantiles import exact_quantiles
from ..operators.sums import exact_sums

STATISTIC_INTENTS = set(aggregate.STATISTICS)


@dataclass(frozen=True)
class Question:
    """What to compute over one table.

    ``intent`` is count, list, table1, describe, top, pooled or a statistic.
    ``entity`` counts or lists entities instead of rows.
    """

    intent: str = "count"
    stages: tuple[Condition, ...] = ()
    group: str | None = None
    target: str | None = None
    columns: tuple[str, ...] = ()
    entity: str | None = None
    n: int | None = None
    least: bool = False
    family: str = "frequency"
    policy: str = "occurrence"
    sort: tuple[str, bool] | None = None
    table: str | None = None
    request: str = ""

    def to_json(self) -> dict:
        out = {k: v for k, v in asdict(self).items() if k != "stages"}
        return {**out, "stages": [c.to_json() for c in self.stages]}

    @classmethod
    def from_json(cls, d: dict) -> Question:
        known = {k: v for k, v in d.items() if k in cls.__dataclass_fields__}
        known["stages"] = tuple(Condition.from_json(c) for c in d.get("stages", ()))
        known["columns"] = tuple(d.get("columns") or ())
        known["sort"] = tuple(d["sort"]) if d.get("sort") else None
        return cls(**known)

    def named_columns(self) -> list[str]:
        """Every column the question touches."""
        names = [self.group, self.target, self.entity, *self.columns, self.sort[0] if self.sort else None]
        for c in self.stages:
            names += [c.column, c.when[0] if c.when else None]
        return list(dict.fromkeys(n for n in names if n))

    def remap(self, columns: list[str]) -> tuple[Question, list[str]]:
        """The question over the current column names, and the names not found."""
        found = {n: match_name(n, columns) for n in self.named_columns()}
        name = lambda n: n and (found.get(n) or n)
        stages = tuple(
            replace(c, column=name(c.column), when=(name(c.when[0]), c.when[1]) if c.when else None)
            for c in self.stages
        )
        moved = replace(
            self, stages=stages, group=name(self.group), target=name(self.target), entity=name(self.entity),
            columns=tuple(name(c) for c in self.columns), sort=(name(self.sort[0]), self.sort[1]) if self.sort else None,
        )
        return moved, [n for n, hit in found.items() if hit is None]


@dataclass(frozen=True)
class Measure:
    """Filter groups, one measure, up to two group columns and a sort."""

    how: str = "count"
    column: str | None = None
    filter_groups: tuple = ()
    groups: tuple[str, ...] = ()
    sort: tuple[str, bool] | None = None
    table: str | None = None


def answer(tables: dict[str, DataFrame], spec: Question | Measure, order_by) -> DataFrame:
    """The result table of one spec."""
    df = tables[spec.table] if spec.table else next(iter(tables.values()))
    return _measure(df, spec) if isinstance(spec, Measure) else _question(df, spec, order_by)


class Answers(list):
    """Result tables, and the copies of filtered rows that they share until ``release``."""

    def __init__(self, tables: list[DataFrame], copies: list[DataFrame]):
        super().__init__(tables)
        self._copies = copies

    def release(self) -> None:
        for copy in self._copies:
            copy.unpersist()
        self._copies = []


def answer_all(tables: dict[str, DataFrame], specs: list, order_by) -> Answers:
    """Several specs over the same tables (X11).

    Questions that share a table and all their filters read the filtered rows
    once; that copy may spill to disk, is rebuilt if an executor is lost, and goes
    when the answers are released.  A Table 1 describes the whole table, as it does
    when asked alone.
    """
    shared = {}
    for s in specs:
        if _filtered(s):
            shared.setdefault((s.table, s.stages), []).append(s)
    cached = {
        at: keep(tables[at[0]] if at[0] else next(iter(tables.values())), list(at[1])).persist()
        for at, group in shared.items()
        if len(group) > 1 and not any(_needs_funnel(s) for s in group)
    }
    out = []
    for s in specs:
        rows = cached.get((s.table, s.stages)) if _filtered(s) else None
        out.append(answer(tables, s, order_by) if rows is None else _question(rows, replace(s, stages=()), order_by))
    return Answers(out, list(cached.values()))


def _filtered(spec: Question | Measure) -> bool:
    return isinstance(spec, Question) and bool(spec.stages) and spec.intent != "table1"


def _needs_funnel(q: Question) -> bool:
    return q.intent == "count" and not q.group


def _question(df: DataFrame, q: Question, order_by) -> DataFrame:
    stages = list(q.stages)
    if q.intent == "list":
        return ranking.list_rows(df, stages, order_by, q.entity, q.sort)
    if q.intent == "table1":
        return aggregate.table1(df, list(q.columns), order_by)
    if q.intent == "describe":
        return aggregate.describe(keep(df, stages), q.target, q.group, order_by)
    if q.intent == "pooled":
        return ranking.top_pooled(df, list(q.columns), order_by, q.policy, q.entity, q.n, q.least, stages)
    if q.intent == "top" and q.family == "magnitude":
        return ranking.top_magnitude(df, q.target, order_by, q.n, q.least, stages)
    if q.intent == "top":
        return ranking.top_frequency(df, q.target, order_by, q.n, q.least, stages)
    if q.intent in STATISTIC_INTENTS:
        return aggregate.summarise(keep(df, stages), q.target, [q.intent], q.group, order_by)
    if q.intent != "count":
        raise ValueError(f"unknown intent {q.intent!r}")
    if q.group:
        return aggregate.group_share(df, q.group, order_by, stages)
    if q.entity:
        return aggregate.entity_funnel(df, q.entity, stages)
    return aggregate.funnel(df, stages)


def _measure(df: DataFrame, m: Measure) -> DataFrame:
    rows = keep_groups(df, [list(g) for g in m.filter_groups])
    if len(m.groups) > 2:
        raise ValueError("at most two group columns")
    for g in m.groups:
        rows = rows.filter(~blank_of(rows, g))
    keys = list(m.groups)
    keyed = rows.select(
        *[quoted(g) for g in keys], (number_of(rows, m.column) if m.column else F.lit(None).cast("double")).alias("__x"),
    )
    if m.how == "median":
        counted = keyed.groupBy(*[quoted(g) for g in keys]).agg(F.count(F.lit(1)).alias("rows"))
        medians = exact_quantiles(keyed, keys, "__x", {"median": 0.5})
        out = counted.join(medians, keys, "left") if keys else medians.withColumn("rows", counted.scalar())
        out = out.select(*[quoted(g) for g in keys], round2(F.col("median")).alias("median"))
    elif m.how == "count":
        out = keyed.groupBy(*[quoted(g) for g in keys]).agg(F.count(F.lit(1)).alias("n"))
    elif m.how in ("sum", "average"):
        out = exact_sums(keyed, keys, "__x", partial={"__n": F.count("__x")}, final={"__n": F.sum("__n")})
        average = round2(F.col("sum") / F.when(F.col("__n") > 0, F.col("__n"))).alias("average")
        out = out.select(*[quoted(g) for g in keys], "sum" if m.how == "sum" else average)
    else:
        raise ValueError(f"unknown measure {m.how!r}")
    if not m.sort:
        return out
    by, descending = m.sort
    column = quoted(by if by in out.columns else out.columns[-1])
    return out.orderBy(column.desc() if descending else column.asc(), *[quoted(g) for g in keys])


def absent_values(df: DataFrame, q: Question) -> DataFrame:
    """Filter values that occur nowhere in their column: ``column, value``.

    All wanted values are looked for in one pass; a set counts as absent only if
    none of its values occurs.
    """
    wanted = [c for c in q.stages if c.kind in ("value", "set")]
    if not wanted:
        return df.sparkSession.createDataFrame([], "column string, value string")
    seen = df.agg(*[
        F.coalesce(F.bool_or(replace(c, negated=False).test(df)), F.lit(False)).alias(f"seen_{i}")
        for i, c in enumerate(wanted)
    ])
    listed = F.array(*[
        F.struct(
            F.lit(c.column).alias("column"),
            F.lit(", ".join(map(str, c.values)) if c.kind == "set" else str(c.value)).alias("value"),
            F.col(f"seen_{i}").alias("seen"),
        )
        for i, c in enumerate(wanted)
    ])
    return seen.select(F.inline(listed)).filter(~F.col("seen")).select("column", "value")
