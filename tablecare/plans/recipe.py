"""A recorded list of steps: build, save, load."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

from ..operators.fixes import Fix
from .question import Question

VERSION = 1
DEFAULT_NAME = "Monthly cleanup"


@dataclass(frozen=True)
class Step:
    """``kind`` is fix, deidentify, question, report_cards or transform."""

    kind: str
    label: str
    fix: Fix | None = None
    column: str | None = None
    question: Question | None = None
    person: str | None = None
    value: str | None = None
    group: str | None = None
    run: Callable[[dict[str, DataFrame]], DataFrame] | None = None

    @property
    def terminal(self) -> bool:
        return self.kind == "report_cards"

    def to_json(self) -> dict:
        if self.kind == "transform":
            raise ValueError("a step that holds code cannot be saved")
        out = {"kind": self.kind, "label": self.label}
        if self.fix:
            out["fix"] = self.fix.to_json()
        if self.question:
            out["question"] = self.question.to_json()
        return {**out, **{k: v for k in ("column", "person", "value", "group") if (v := getattr(self, k))}}

    @classmethod
    def from_json(cls, d: dict) -> Step:
        fix = Fix(d["fix"]["name"], d["fix"].get("column"), d["fix"].get("params") or {}) if d.get("fix") else None
        question = Question.from_json(d["question"]) if d.get("question") else None
        rest = {k: d.get(k) for k in ("column", "person", "value", "group")}
        return cls(d.get("kind", "unknown"), d.get("label", ""), fix=fix, question=question, **rest)


def fix_step(fix: Fix) -> Step:
    return Step("fix", fix.label, fix=fix)


def deidentify_step(column: str) -> Step:
    return Step("deidentify", f"codes for {column}", column=column)


def question_step(request: str, question: Question) -> Step:
    return Step("question", request, question=replace(question, request=request))


def report_cards_step(person: str, value: str | None = None, group: str | None = None) -> Step:
    return Step("report_cards", f"report cards per {person}", person=person, value=value, group=group)


def transform_step(label: str, run: Callable[[dict[str, DataFrame]], DataFrame]) -> Step:
    """A whole-table transform given as code (V1)."""
    return Step("transform", label, run=run)


def run_transform(run: Callable[[dict[str, DataFrame]], DataFrame], tables: dict[str, DataFrame]) -> DataFrame:
    """Run a user's transform; anything but a table is refused (V1)."""
    out = run(tables)
    if not isinstance(out, DataFrame):
        raise TypeError(f"a transform must return a DataFrame, not {type(out).__name__}")
    return out


@dataclass(frozen=True)
class Recipe:
    name: str = DEFAULT_NAME
    steps: tuple[Step, ...] = ()

    def add(self, step: Step) -> Recipe:
        """The recipe with one more step; report cards stay last and alone."""
        if step.terminal:
            return replace(self, steps=(*[s for s in self.steps if not s.terminal], step))
        if any(s.terminal for s in self.steps):
            raise ValueError("no step can follow the report cards")
        return replace(self, steps=(*self.steps, step))

    def dumps(self) -> str:
        return json.dumps({"version": VERSION, "name": self.name, "steps": [s.to_json() for s in self.steps]}, indent=2)

    @classmethod
    def loads(cls, text: str) -> Recipe:
        try:
            d = json.loads(text)
        except json.JSONDecodeError as error:
            raise ValueError("this is no saved recipe: it could not be read") from error
        if not isinstance(d, dict) or not isinstance(d.get("steps"), list):
            raise ValueError("this is no saved recipe: it has no steps")
        name = d.get("name") if isinstance(d.get("name"), str) and d["name"].strip() else DEFAULT_NAME
        return cls(name.strip(), tuple(Step.from_json(s) for s in d["steps"]))

    def save(self, spark: SparkSession, path: str) -> None:
        """Write the recipe to any path Spark can reach."""
        spark.createDataFrame([(self.dumps(),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Recipe:
        return cls.loads(spark.read.text(path, wholetext=True).head()["value"])
