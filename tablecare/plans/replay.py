"""Replaying a recipe on the next delivery of a table."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import match_name
from ..functions.text import fold_key, quoted
from ..operators.cells import blank_of
from ..operators.fixes import Fix, follow
from ..operators.provenance import Trail
from .codes import deidentify, empty_codes
from .question import absent_values, answer
from .recipe import Recipe, Step, run_transform
from .report_cards import ReportCards, report_cards

STEP_SCHEMA = "step int, label string, skipped boolean, note string, rows_before long, rows_after long, cells_changed long"
SURPRISE_SCHEMA = "step int, type string, column string, detail string"


def unmerged_spellings(df: DataFrame, column: str) -> DataFrame:
    """Spellings that fold together and that no rule merged: ``key, spelling, n``."""
    spelled = df.filter(~blank_of(df, column)).groupBy(
        fold_key(quoted(column)).alias("key"), quoted(column).alias("spelling")
    ).agg(F.count(F.lit(1)).alias("n"))
    several = spelled.groupBy("key").agg(F.count(F.lit(1)).alias("spellings")).filter("spellings > 1")
    return spelled.join(several, "key").select("key", "spelling", "n")


@dataclass
class Replay:
    """What a replay gives.

    ``steps`` and ``surprises`` say what ran and what the recipe did not cover.  Fixes in a
    row run once, over a stored trail; the other parts are lazy tables over it.
    """

    rows: DataFrame
    steps: DataFrame
    surprises: DataFrame
    codes: DataFrame
    new_people: DataFrame | None
    answers: dict[str, DataFrame]
    cards: ReportCards | None
    removed: list[DataFrame] = field(default_factory=list)


class _Run:
    """The state one replay carries from step to step."""

    def __init__(self, df: DataFrame, order_by, codes: DataFrame | None, prefix: str):
        self.spark, self.order_by, self.prefix = df.sparkSession, order_by, prefix
        self.settled, self.names = df, list(df.columns)
        self.codes = codes if codes is not None else empty_codes(self.spark)
        self.new_people, self.cards, self.answers, self.removed = None, None, {}, []
        self.step_rows, self.surprises = [], []
        self.trail, self.followed, self.merged = None, [], []

    @property
    def rows(self) -> DataFrame:
        """The rows as they are now; fixes since the last settled state are stored first."""
        if self.trail is not None:
            done, followed, merged = self.trail.store(), self.followed, self.merged
            self.trail, self.followed, self.merged = None, [], []
            at = F.element_at(F.array(*[F.lit(i) for i, _ in followed]), F.col("step") + 1)
            label = F.element_at(F.array(*[F.lit(step.label) for _, step in followed]), F.col("step") + 1)
            self.step_rows.append(done.steps().select(
                at.alias("step"), label.alias("label"), F.lit(False).alias("skipped"), F.lit(None).cast("string").alias("note"),
                "rows_before", "rows_after", "cells_changed",
            ))
            for i, place, column, name in merged:
                spelled = done.after(place).select(F.col(name).alias(column))
                self.found(i, "newCategoryVariant", column, unmerged_spellings(spelled, column), F.col("spelling"))
            self.removed.append(done.removed.drop("removed_by"))
            self.settled = done.rows
        return self.settled

    @rows.setter
    def rows(self, df: DataFrame) -> None:
        self.settled = df

    def surprise(self, i: int, kind: str, column: str | None, detail: str) -> None:
        self.surprises.append(self.spark.createDataFrame([(i, kind, column, detail)], SURPRISE_SCHEMA))

    def found(self, i: int, kind: str, column: str, data: DataFrame, detail: Column) -> None:
        """Surprises that depend on the data, one row each."""
        self.surprises.append(data.select(
            F.lit(i).alias("step"), F.lit(kind).alias("type"), F.lit(column).alias("column"),
            detail.cast("string").alias("detail"),
        ))

    def record(self, i: int, step: Step, before: DataFrame, changed: Column | None = None, note: str | None = None,
               skipped: bool = False, counts: DataFrame | None = None) -> None:
        count = lambda d: d.agg(F.count(F.lit(1)).alias("n"))
        base = counts if counts is not None else count(before).withColumnRenamed("n", "rows")
        after = F.col("rows") if self.rows is before or counts is not None else count(self.rows).scalar()
        self.step_rows.append(base.select(
            F.lit(i).alias("step"), F.lit(step.label).alias("label"), F.lit(skipped).alias("skipped"),
            F.lit(note).cast("string").alias("note"), F.col("rows").alias("rows_before"), after.alias("rows_after"),
            (changed if changed is not None else F.lit(0)).cast("long").alias("cells_changed"),
        ))

    def column(self, i: int, step: Step, recorded: str) -> str | None:
        """The current name of a recorded column; a missing one is reported, never guessed."""
        found = match_name(recorded, self.names)
        if found is None:
            self.surprise(i, "missingColumn", recorded, f"no column matches {recorded}")
        return found

    def skip(self, i: int, step: Step) -> None:
        self.record(i, step, self.rows, note="skipped", skipped=True)

    # --- one method per kind of step -------------------------------------------------

    def fix(self, i: int, step: Step) -> None:
        fix = step.fix
        if fix.column is not None:
            column = self.column(i, step, fix.column)
            if column is None:
                return self.skip(i, step)
            fix = replace(fix, column=column)
        if fix.name == "keep_one":
            fix = self._survivor(i, step, fix)
            if fix is None:
                return self.skip(i, step)
        if self.trail is None:
            self.trail = Trail(self.settled, self.order_by)
        place = follow(self.trail, fix)
        self.followed.append((i, step))
        if fix.name == "merge_spellings":
            self.merged.append((i, place, fix.column, self.trail.remember(fix.column)))

    def _survivor(self, i: int, step: Step, fix: Fix) -> Fix | None:
        mode, _, date = fix.params.get("policy", "firstrow").partition("::")
        if not date:
            return fix
        column = self.column(i, step, date)
        return column and replace(fix, params={**fix.params, "policy": f"{mode}::{column}"})

    def deidentify(self, i: int, step: Step) -> None:
        column, before = self.column(i, step, step.column), self.rows
        if column is None:
            return self.skip(i, step)
        coded = deidentify(before, column, self.order_by, self.codes, self.prefix)
        self.rows, self.codes = coded.rows, coded.codes
        self.new_people = coded.new if self.new_people is None else self.new_people.unionByName(coded.new)
        self.found(i, "newPerson", column, coded.new, F.col("code"))
        self.record(i, step, before, counts=before.agg(F.count(F.lit(1)).alias("rows")))

    def question(self, i: int, step: Step) -> None:
        asked, lost = step.question.remap(self.names)
        if lost:
            for name in lost:
                self.surprise(i, "missingColumn", name, f"no column matches {name}")
            return self.skip(i, step)
        missing = absent_values(self.rows, asked)
        self.surprises.append(missing.select(
            F.lit(i).alias("step"), F.lit("missingValue").alias("type"), "column", F.col("value").alias("detail")
        ))
        self.answers[step.label] = answer({"table": self.rows}, replace(asked, table=None), self.order_by)
        self.record(i, step, self.rows)

    def report_cards(self, i: int, step: Step) -> None:
        person = self.column(i, step, step.person)
        if person is None:
            return self.skip(i, step)
        value = self.column(i, step, step.value) if step.value else None
        group = self.column(i, step, step.group) if step.group else None
        self.cards = report_cards(self.rows, person, value, group)
        self.found(i, "smallCell", group or "", self.cards.warnings, F.col("group"))
        self.record(i, step, self.rows)

    def transform(self, i: int, step: Step) -> None:
        before = self.rows
        self.rows = run_transform(step.run, {"table": before})
        self.names = list(self.rows.columns)
        self.record(i, step, before)


def replay(recipe: Recipe, df: DataFrame, order_by, codes: DataFrame | None = None, prefix: str = "Person") -> Replay:
    """Run the recorded steps on a new table.

    A step whose column is gone is skipped and reported.  Report cards whose
    value or group column is gone fall back to row counts or no groups, and say
    so (X8).
    """
    run = _Run(df, order_by, codes, prefix)
    kinds = {"fix", "deidentify", "question", "report_cards", "transform"}
    for i, step in enumerate(recipe.steps):
        if step.kind in kinds:
            getattr(run, step.kind)(i, step)
        else:
            run.surprise(i, "unknownStep", None, f"step of unknown kind {step.kind}")
            run.skip(i, step)
    union = lambda parts, schema: reduce(
        DataFrame.unionByName, parts, run.spark.createDataFrame([], schema)
    )
    rows = run.rows
    return Replay(
        rows, union(run.step_rows, STEP_SCHEMA), union(run.surprises, SURPRISE_SCHEMA), run.codes,
        run.new_people, run.answers, run.cards, run.removed,
    )
