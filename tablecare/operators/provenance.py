"""One stored table behind a chain of fixes: rows that know what happened to them.

A trail carries every row through the chain, also those that a step removes.  A row
knows the step that removed it (``__gone``), the step that made it (``__born``, for
the further items of a split cell) and which cell fixes changed it (``__changed``).  The chain
runs once, when the trail is stored; kept rows, removed rows and the log of every
step are filters and one aggregate of the stored table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quoted, split_list
from ..session import cut_lineage
from .rows import mark_copies, mark_survivors

OWN = ["__gone", "__born", "__changed"]


@dataclass(frozen=True)
class Stored:
    """What a stored trail gives.  ``steps`` has one row: per step i ``changed_i``, ``before_i`` and ``after_i``."""

    table: DataFrame
    columns: list[str]
    labels: list[str]

    @property
    def rows(self) -> DataFrame:
        return self.table.filter(F.col("__gone").isNull()).select(*[quoted(c) for c in self.columns])

    @property
    def removed(self) -> DataFrame:
        """Removed rows as they were, with the label of the step in ``removed_by``."""
        by = F.element_at(F.array(*[F.lit(x) for x in self.labels]), F.col("__gone") + 1) if self.labels else F.lit("")
        return self.table.filter(F.col("__gone").isNotNull()).select(*[quoted(c) for c in self.columns], by.alias("removed_by"))

    def after(self, step: int) -> DataFrame:
        """The table's rows that were there after a step."""
        return self.table.filter(_there(step, True))

    def steps(self) -> DataFrame:
        """``step, label, cells_changed, rows_before, rows_after``, from one aggregate."""
        if not self.labels:
            return self.table.sparkSession.createDataFrame([], "step int, label string, cells_changed long, rows_before long, rows_after long")
        totals = self.table.agg(*[
            c for i in range(len(self.labels)) for c in (
                F.count_if(F.col("__born").isNull() & F.array_contains("__changed", i)).alias(f"changed_{i}"),
                F.count_if(_there(i, False)).alias(f"before_{i}"), F.count_if(_there(i, True)).alias(f"after_{i}"),
            )
        ])
        return totals.select(F.inline(F.array(*[
            F.struct(
                F.lit(i).alias("step"), F.lit(label).alias("label"), F.col(f"changed_{i}").alias("cells_changed"),
                F.col(f"before_{i}").alias("rows_before"), F.col(f"after_{i}").alias("rows_after"),
            )
            for i, label in enumerate(self.labels)
        ])))


def _there(step: int, after: bool) -> Column:
    born, gone = F.col("__born"), F.col("__gone")
    if after:
        return (born.isNull() | (born <= step)) & (gone.isNull() | (gone > step))
    return (born.isNull() | (born < step)) & (gone.isNull() | (gone >= step))


class Trail:
    """A chain of fixes being built; nothing runs before ``store``."""

    def __init__(self, df: DataFrame, order_by):
        self.columns, self.order_by, self.labels, self.kept = list(df.columns), order_by, [], []
        none = F.lit(None).cast("int")
        self.table = df.select("*", none.alias("__gone"), none.alias("__born"), F.array().cast("array<int>").alias("__changed"))

    def _next(self, label: str) -> int:
        self.labels.append(label)
        return len(self.labels) - 1

    def cell(self, label: str, column: str, on) -> int:
        """Replace a column's cells by ``on`` of them, in rows that are still there."""
        step, alive = self._next(label), F.col("__gone").isNull()
        old = quoted(column)
        new = F.when(alive, on(old)).otherwise(old)
        added = F.when(old.eqNullSafe(new), F.col("__changed")).otherwise(F.concat("__changed", F.array(F.lit(step))))
        self.table = self.table.select(
            *[new.alias(c) if c == column else quoted(c) for c in self.columns], "__gone", "__born", added.alias("__changed"), *self.kept,
        )
        return step

    def _removed(self, step: int, marked: DataFrame) -> int:
        gone = F.when(~F.col("__kept"), F.lit(step)).otherwise(F.col("__gone"))
        self.table = marked.withColumn("__gone", gone).drop("__kept")
        return step

    def copies(self, label: str, among: Column | None = None) -> int:
        """Remove all but the first of equal rows."""
        step, alive = self._next(label), F.col("__gone").isNull()
        return self._removed(step, mark_copies(self.table, self.order_by, self.columns, alive if among is None else alive & among))

    def survivors(self, label: str, entity: str, policy: str) -> int:
        """Remove all rows of an entity but the one a policy chooses."""
        step = self._next(label)
        return self._removed(step, mark_survivors(self.table, entity, policy, self.order_by, self.columns, F.col("__gone").isNull()))

    def split(self, label: str, column: str) -> int:
        """A row per item of a list cell."""
        step, alive = self._next(label), F.col("__gone").isNull()
        items = F.when(alive, split_list(quoted(column))).otherwise(F.array(quoted(column)))
        split = self.table.select("*", F.posexplode(items).alias("__at", "__item"))
        born = F.when(F.col("__at") > 0, F.lit(step)).otherwise(F.col("__born"))
        self.table = split.select(
            *[F.col("__item").alias(c) if c == column else quoted(c) for c in self.columns], "__gone", born.alias("__born"), "__changed", *self.kept,
        )
        return step

    def remember(self, column: str) -> str:
        """Keep a column as it is now beside its later states; the name it has in the stored table."""
        name = f"__kept{len(self.kept)}"
        self.table = self.table.withColumn(name, quoted(column))
        self.kept.append(name)
        return name

    def store(self) -> Stored:
        return Stored(cut_lineage(self.table), self.columns, self.labels)
