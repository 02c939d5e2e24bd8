"""Conditions on rows and entities."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import term_key
from ..functions.text import quoted
from .cells import blank_of, data_type, is_text, key_of, missing_of, number_of


def folded(value) -> str:
    """The comparison key of a literal, the same way the columns fold."""
    return " ".join(str(value).lower().split())


def _literal(df: DataFrame, column: str, value) -> Column:
    """A literal in the type its column is compared in, so typed filters push down."""
    return F.lit(folded(value)) if is_text(df, column) else F.lit(value).cast(data_type(df, column))


_COMPARE = {
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "<>": lambda a, b: a != b,
}
_OPPOSITE = {">": "<=", "<=": ">", ">=": "<", "<": ">=", "=": "<>", "<>": "="}


@dataclass(frozen=True)
class Condition:
    """One test on one column.

    ``kind`` is value, set, threshold or blank.  A negated value or set also
    holds for a null cell; a threshold never holds for an unreadable number.
    """

    kind: str
    column: str
    value: object = None
    values: tuple = ()
    op: str = "="
    when: tuple | None = None
    present: bool = False
    negated: bool = False

    def test(self, df: DataFrame) -> Column:
        c = quoted(self.column)
        if self.kind == "blank":
            missing = missing_of(df, self.column)
            return ~missing if self.present else missing
        if self.kind in ("value", "set"):
            wanted = (self.value,) if self.kind == "value" else self.values
            hit = key_of(df, self.column).isin(*[_literal(df, self.column, v) for v in wanted]) \
                if wanted else F.lit(False)
            return (c.isNull() | ~hit) if self.negated else (c.isNotNull() & hit)
        if self.kind == "threshold":
            return F.coalesce(reduce(and_, self.conjuncts(df)), F.lit(False))
        raise ValueError(f"unknown condition kind {self.kind!r}")

    def conjuncts(self, df: DataFrame) -> list[Column]:
        """The test as separate parts for a filter, which takes null as no; typed parts reach the scan."""
        if self.kind != "threshold":
            return [self.test(df)]
        compare, kind = _COMPARE[self.op], data_type(df, self.column)
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            c = quoted(self.column)
            limit = float("inf")
            return [*self._guard(df), compare(c, F.lit(float(self.value))), ~F.isnan(c), c != F.lit(limit), c != F.lit(-limit)]
        return [*self._guard(df), compare(number_of(df, self.column), F.lit(float(self.value)))]

    def _guard(self, df: DataFrame) -> list[Column]:
        return [Condition("value", self.when[0], value=self.when[1]).test(df)] if self.when else []

    def unreadable(self, df: DataFrame) -> Column:
        """Rows a threshold could not read, within its guard."""
        if self.kind != "threshold":
            return F.lit(False)
        return F.coalesce(
            reduce(and_, [*self._guard(df), number_of(df, self.column).isNull()]), F.lit(False)
        )

    def blank_cell(self, df: DataFrame) -> Column:
        """Rows whose cell is blank, stated for value and set tests."""
        return blank_of(df, self.column) if self.kind in ("value", "set") else F.lit(False)

    def negate(self) -> Condition:
        """The opposite condition (P10)."""
        if self.kind == "blank":
            return replace(self, present=not self.present)
        op = _OPPOSITE[self.op] if self.kind == "threshold" else self.op
        return replace(self, op=op, negated=not self.negated)

    def positive(self) -> Condition | None:
        """The positive twin of a negated value or set, which entities are tested by."""
        return replace(self, negated=False) if self.negated and self.kind in ("value", "set") else None

    @property
    def phrase(self) -> str:
        if self.kind == "blank":
            return f"{self.column} is {'present' if self.present else 'missing'}"
        if self.kind == "value":
            return f"{self.column} {'is not' if self.negated else '='} {self.value}"
        if self.kind == "set":
            return f"{self.column} {'not in' if self.negated else 'in'} ({', '.join(map(str, self.values))})"
        guard = f" when {self.when[0]} = {self.when[1]}" if self.when else ""
        return f"{self.column} {self.op} {self.value}{guard}"

    def to_json(self) -> dict:
        out = {"kind": self.kind, "column": self.column}
        if self.kind == "blank":
            return {**out, "present": self.present}
        if self.kind == "set":
            return {**out, "values": list(self.values), "negated": self.negated}
        if self.kind == "value":
            return {**out, "value": self.value, "negated": self.negated}
        when = {"column": self.when[0], "value": self.when[1]} if self.when else None
        return {**out, "op": self.op, "value": self.value, "when": when, "negated": self.negated}

    @classmethod
    def from_json(cls, d: dict) -> Condition:
        when = d.get("when")
        return cls(
            d["kind"], d["column"], value=d.get("value"), values=tuple(d.get("values") or ()),
            op=d.get("op") or "=", when=(when["column"], when["value"]) if when else None,
            present=bool(d.get("present")), negated=bool(d.get("negated")),
        )


def equals(column: str, value, negated: bool = False) -> Condition:
    return Condition("value", column, value=value, negated=negated)


def one_of(column: str, values, negated: bool = False) -> Condition:
    return Condition("set", column, values=tuple(values), negated=negated)


def threshold(column: str, op: str, value: float, when: tuple | None = None) -> Condition:
    return Condition("threshold", column, value=value, op=op, when=when)


def missing(column: str) -> Condition:
    return Condition("blank", column)


def present(column: str) -> Condition:
    return Condition("blank", column, present=True)


def all_of(df: DataFrame, conditions: list[Condition]) -> Column:
    return reduce(and_, [c.test(df) for c in conditions], F.lit(True))


def keep(df: DataFrame, conditions: list[Condition]) -> DataFrame:
    """The rows every condition holds for; also the rows behind a count."""
    return reduce(lambda d, part: d.filter(part), [part for c in conditions for part in c.conjuncts(df)], df)


def filter_groups_test(df: DataFrame, groups: list[list[tuple]]) -> Column:
    """OR over AND-groups of equalities; no real group keeps every row."""
    real = [g for g in (groups or []) if g]
    if not real:
        return F.lit(True)
    return reduce(or_, [all_of(df, [equals(c, v) for c, v in g]) for g in real])


def keep_groups(df: DataFrame, groups: list[list[tuple]]) -> DataFrame:
    return df.filter(filter_groups_test(df, groups))


def apply_filter(df: DataFrame, chosen) -> DataFrame:
    """None, one (column, value) equality, or a list of AND-groups."""
    if not chosen:
        return df
    return keep(df, [equals(*chosen)]) if isinstance(chosen, tuple) else keep_groups(df, chosen)


def keep_listed(df: DataFrame, column: str, values: DataFrame, value_column: str, negated: bool = False) -> DataFrame:
    """Set membership against a table of values (P3, P4 for sets too big for literals).

    A null cell is not in the set, so the anti join keeps it.
    """
    wanted = values.select(key_of(values, value_column).alias("__wanted")).distinct()
    return df.join(wanted, key_of(df, column) == F.col("__wanted"), "left_anti" if negated else "left_semi")


def entity_flags(df: DataFrame, entity: str, conditions: list[Condition]) -> DataFrame:
    """One row per non-blank entity with ``pass_i`` for every condition.

    An entity passes if any of its rows does; a negated value or set passes only
    if no row matches the positive form.  ``unreadable_i`` counts the rows a
    threshold could not read.
    """
    aggregates = []
    for i, condition in enumerate(conditions):
        twin = condition.positive()
        any_row = F.bool_or((twin or condition).test(df))
        aggregates += [
            (~any_row if twin else any_row).alias(f"pass_{i}"),
            F.count_if(condition.unreadable(df)).alias(f"unreadable_{i}"),
        ]
    rows = df.filter(~blank_of(df, entity))
    key = key_of(df, entity).alias("entity_key")
    return rows.groupBy(key).agg(*aggregates) if aggregates else rows.select(key).distinct()


@dataclass(frozen=True)
class Definition:
    """A named rule: a guarded threshold, or a list of values that count."""

    term: str
    column: str | None
    kind: str
    op: str | None = None
    value: float | None = None
    when: tuple | None = None
    values: tuple = field(default_factory=tuple)

    def condition(self) -> Condition:
        if self.column is None:
            raise ValueError(f"{self.term!r} names no column")
        if self.kind == "threshold":
            return threshold(self.column, self.op, self.value, self.when)
        return one_of(self.column, self.values)


def definition_flags(df: DataFrame, definitions: list[Definition]) -> DataFrame:
    """``df`` with one boolean column per defined term, in a single projection."""
    return df.select("*", *[d.condition().test(df).alias(f"is_{term_key(d.term)}") for d in definitions])


def keep_defined(df: DataFrame, definitions: list[Definition], term: str) -> DataFrame:
    """Rows a named definition holds for."""
    found = next((d for d in definitions if term_key(d.term) == term_key(term)), None)
    if found is None:
        raise KeyError(f"no definition for {term!r}")
    return keep(df, [found.condition()])
