from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tablecare.functions import words
from tablecare.functions.names import name_key
from tablecare.operators import matching
from tablecare.operators.conditions import equals, one_of, threshold
from tablecare.operators.fixes import Fix
from tablecare.plans import codes as coding
from tablecare.plans.masked_sample import masked_sample
from tablecare.plans.question import Measure, Question, absent_values, answer, answer_all
from tablecare.plans.recipe import (
    Recipe, deidentify_step, fix_step, question_step, report_cards_step, run_transform, transform_step,
)
from tablecare.plans.replay import replay, unmerged_spellings
from tablecare.plans.report_cards import bars, report_cards

MONTH1 = [("Dr A", "Amoxicillin", "500", "North"), ("Dr A", "Amoxicillin", "500", "North"), ("Dr B", "amoxicillin", "1,000", "North"), ("Dr C", "cipro", "250", "South")]
MONTH2 = [("Dr B", "AMOXICILLIN", "5", "North"), ("Dr D", "amoxicillin", "6", "North"), ("Dr E", "cipro", "7", "West"), ("Dr A", "Amoxicillin", "8", "North")]


@pytest.fixture
def recipe():
    out = Recipe("monthly")
    for step in [
        fix_step(Fix("dedupe_rows")), fix_step(Fix("merge_spellings", "Drug", {"map": {"amoxicillin": "Amoxicillin"}})),
        fix_step(Fix("number_text", "Dose")), question_step("amox", Question(stages=(equals("Drug", "amoxicillin"), equals("Clinic", "East")))),
        deidentify_step("Prescriber"), report_cards_step("Prescriber", "Dose", "Clinic"),
    ]:
        out = out.add(step)
    return out


def test_recipes_survive_a_round_trip(recipe, spark, tmp_path):
    assert Recipe.loads(recipe.dumps()) == recipe
    recipe.save(spark, str(tmp_path / "recipe"))
    assert Recipe.load(spark, str(tmp_path / "recipe")) == recipe
    for bad in ("nonsense", "[]", '{"name": "x"}'):
        with pytest.raises(ValueError, match="no saved recipe"):
            Recipe.loads(bad)


def test_report_cards_stay_last(recipe):
    with pytest.raises(ValueError, match="report cards"):
        recipe.add(fix_step(Fix("dedupe_rows")))
    again = recipe.add(report_cards_step("Prescriber"))
    assert len(again.steps) == len(recipe.steps) and again.steps[-1].value is None
    with pytest.raises(ValueError, match="cannot be saved"):
        Recipe().add(transform_step("t", lambda t: t["table"])).dumps()


def test_replay_reports_what_the_rules_do_not_cover(recipe, frame):
    first = replay(recipe, frame("Prescriber, Drug, Dose, Clinic", MONTH1), "row_id", prefix="Prescriber")
    assert [r["code"] for r in first.codes.orderBy("seq").collect()] == ["Prescriber 01", "Prescriber 02", "Prescriber 03"]
    assert first.steps.filter("step = 0").first()["rows_after"] == 3
    month2 = frame("prescriber, Drug, DoseAmount, Clinic", MONTH2)
    got = replay(recipe, month2, "row_id", codes=first.codes, prefix="Prescriber")
    surprises = {(r["type"], r["column"], r["detail"]) for r in got.surprises.collect()}
    assert {("newCategoryVariant", "Drug", "AMOXICILLIN"), ("newCategoryVariant", "Drug", "Amoxicillin"), ("newPerson", "prescriber", "Prescriber 04"),
            ("newPerson", "prescriber", "Prescriber 05"), ("smallCell", "Clinic", "West"), ("missingValue", "Clinic", "East")} <= surprises
    assert got.surprises.filter("type = 'missingColumn' AND column = 'Dose'").count() == 2  # for the fix and for the cards
    steps = {r["step"]: r for r in got.steps.collect()}
    assert steps[2]["skipped"] and not steps[1]["skipped"]
    assert {r["prescriber"] for r in got.rows.collect()} == {"Prescriber 01", "Prescriber 02", "Prescriber 04", "Prescriber 05"}
    assert {(r["person"], r["group"], r["value"]) for r in got.cards.cards.collect()} == {
        ("Prescriber 02", "North", 1.0), ("Prescriber 04", "North", 1.0), ("Prescriber 01", "North", 1.0), ("Prescriber 05", "West", 1.0),
    }
    assert [r["matched"] for r in got.answers["amox"].orderBy("stage").collect()] == [3, 0]


def test_replaying_twice_gives_the_same_codes(recipe, frame):
    runs = [replay(recipe, frame("Prescriber, Drug, Dose, Clinic", MONTH1, partitions=p), "row_id") for p in (1, 4)]
    assert runs[0].codes.orderBy("seq").collect() == runs[1].codes.orderBy("seq").collect()


def test_replay_re_matches_the_survivor_date_and_skips_unknown_steps(frame):
    steps = '{"steps": [{"kind": "fix", "label": "one", "fix": {"name": "keep_one", "column": "MRN", "params": {"policy": "last::Visit Date"}}},' \
            ' {"kind": "magic", "label": "?"}, {"kind": "fix", "label": "x", "fix": {"name": "keep_one", "column": "mrn", "params": {"policy": "first::gone"}}}]}'
    got = replay(Recipe.loads(steps), frame("mrn, visit_date", [("1", "2024-01-01"), ("1", "2024-02-01")]), "row_id")
    assert [r["row_id"] for r in got.rows.collect()] == [1]
    assert {r["type"] for r in got.surprises.collect()} == {"unknownStep", "missingColumn"}


def test_codes_are_stable_saved_and_checked(frame, spark, tmp_path):
    df = frame("doc", [("Dr Z",), (" Dr A",), (None,), ("Dr Z ",)])
    coded = coding.deidentify(df, "doc", "row_id", prefix="Person")
    assert [(r["row_id"], r["doc"]) for r in coded.rows.orderBy("row_id").collect()] == [(0, "Person 01"), (1, "Person 02"), (2, None), (3, "Person 01")]
    path = str(tmp_path / "codes")
    coding.save_codes(coded.codes, path)
    assert coding.load_codes(spark, path).count() == 2
    assert coding.deidentify(df, "doc", "row_id", coding.load_codes(spark, path)).new.count() == 0
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        coding.save_codes(coded.codes, path)
    coded.codes.unionByName(coded.codes).write.parquet(str(tmp_path / "twice"))
    with pytest.raises(ValueError, match="twice"):
        coding.load_codes(spark, str(tmp_path / "twice"))


def test_a_person_in_two_groups_has_two_cards(frame):
    df = frame("p, v, g", [("A", "4", "N"), ("A", "6", "N"), ("A", "5", "S"), ("B", "x", "N"), ("C", "1", None)])
    cards = report_cards(df, "p", "v", "g")
    assert {(r["person"], r["group"]): (r["value"], r["group_size"], r["small_cell"]) for r in cards.cards.collect()} == {
        ("A", "N"): (10.0, 2, True), ("A", "S"): (5.0, 1, True), ("B", "N"): (0.0, 2, True), ("C", "(no group)"): (1.0, 1, True),
    }
    shown = [(r["label"], r["value"], r["is_subject"]) for r in bars(cards, ["B"]).collect()]
    assert shown == [("A", 10.0, False), ("B", 0.0, True)]


def test_questions_answer_like_the_operators(frame):
    df = frame("Dx, Days, id", [("UTI", "3", "1"), ("uti", "5", "2"), ("flu", "9", "2"), (None, "N/A", "3")])
    run = lambda q: answer({"t": df}, q, "row_id")
    assert run(Question(stages=(one_of("Dx", ["uti"]),))).first()["matched"] == 2
    assert run(Question(stages=(equals("Dx", "uti"),), entity="id")).first()["out_of"] == 3
    assert run(Question(intent="median", target="Days", group="Dx")).filter("label = 'UTI'").first()["median"] == 4.0
    assert run(Question(intent="top", target="Dx", n=1)).first()["label"] == "UTI"
    assert run(Question(intent="top", family="magnitude", target="Days", n=1)).first()["row_id"] == 2
    assert run(Question(intent="list", stages=(threshold("Days", ">", 4),), sort=("Days", True))).first()["row_id"] == 2
    assert run(Question(intent="table1", columns=("Dx",))).count() == 3
    measure = Measure("average", "Days", ((("Dx", "UTI"),),), ("Dx",), ("average", True))
    assert [tuple(r) for r in answer({"t": df}, measure, "row_id").collect()] == [("uti", 5.0), ("UTI", 3.0)]
    assert answer({"t": df}, Measure("median", "Days"), "row_id").first()["median"] == 5.0
    with pytest.raises(ValueError, match="unknown intent"):
        run(Question(intent="guess"))


def test_questions_move_to_renamed_columns(frame):
    q = Question(stages=(threshold("Dose mg", ">", 1, when=("Ward", "A")),), group="Drug", target="gone", sort=("Drug", True))
    moved, lost = q.remap(["dose_mg", "ward", "DRUG"])
    assert moved.stages[0].column == "dose_mg" and moved.stages[0].when == ("ward", "A") and moved.sort == ("DRUG", True) and lost == ["gone"]
    assert Question.from_json(q.to_json()) == q
    df = frame("Drug", [("amox",), (None,)])
    assert [tuple(r) for r in absent_values(df, Question(stages=(equals("Drug", "AMOX"), equals("Drug", "x", True)))).collect()] == [("Drug", "x")]


def test_compound_answers_share_their_filter(frame):
    df = frame("Dx, w", [("UTI", "A"), ("flu", "A"), ("UTI", "B")])
    stages = (equals("w", "A"),)
    top, groups = answer_all({"t": df}, [Question("top", stages, target="Dx"), Question(stages=stages, group="Dx")], "row_id")
    assert {r["label"]: r["n"] for r in top.collect()} == {r["label"]: r["n"] for r in groups.collect()} == {"UTI": 1, "flu": 1}


def test_transforms_must_return_a_table(frame):
    df = frame("a", [("1",)])
    assert run_transform(lambda t: t["t"].select("a"), {"t": df}).columns == ["a"]
    with pytest.raises(TypeError, match="must return a DataFrame"):
        run_transform(lambda t: [1, 2], {"t": df})


def test_masked_sample(frame):
    df = frame("name, mrn", [(f"Dr Smith{i:02d}", "MRN-00042") for i in range(30)])
    got = masked_sample(df, "row_id", withheld=["mrn"]).collect()
    assert len(got) == 10 and {r["mrn"] for r in got} == {"[withheld]"}
    assert all(re.fullmatch(r"[A-Z][a-z] [A-Z][a-z]{4}\d\d", r["name"]) for r in got) and len({r["name"][:6] for r in got}) > 1


def test_phrases_meet_values(frame):
    index = matching.value_index(frame("Organism, Drug", [
        ("ESCHERICHIA COLI", "amoxicillin"), ("Escherichia coli ", "cephalexin"), ("Klebsiella", "Amoxicillin clavulanate"), (None, "doxy"),
    ]), ["Organism", "Drug"])
    best = {r["phrase"]: (r["value"], r["score"]) for r in matching.value_candidates(index, ["e coli", "amoxicillin", "coli", "zzz"], n=1).collect()}
    assert best["amoxicillin"] == ("amoxicillin", 3.0) and best["e coli"][1] == 1.0 and best["coli"][1] == 2.0 and "zzz" not in best
    typos = [(r["value"], r["distance"]) for r in matching.typo_candidates(index, ["amoxicilin", "cephalexn", "dox"]).collect()]
    assert ("amoxicillin", 0) in typos and ("cephalexin", 1) in typos and all(v != "doxy" for v, _ in typos)
    near = [(r["kind"], r["value"]) for r in matching.nearest_values(index, ["Organism", "Drug"], ["organism drug klebs"], n=3).collect()]
    assert set(near) == {("column", "Drug"), ("column", "Organism"), ("value", "Klebsiella")}


def test_names_fold():
    assert name_key("Patient ID") == name_key("patient_id") == "patientid"


def test_typos_against_every_word(spark):
    rng = random.Random(1)
    values = list({"".join(rng.choices("abcde", k=rng.randint(2, 9))) for _ in range(400)})
    phrases = list({"".join(rng.choices("abcde", k=rng.randint(3, 9))) for _ in range(30)})
    index = matching.value_index(spark.createDataFrame([(v,) for v in values], "c string"), ["c"])
    got = {(r["phrase"], r["value"], r["distance"]) for r in matching.typo_candidates(index, phrases).collect()}
    pairs = spark.createDataFrame([(p, v) for p in phrases for v in values], "p string, v string").select(
        "p", "v", F.levenshtein(words.fold_spelling(F.col("p")), words.fold_spelling(F.col("v"))).alias("d"), words.typo_budget(F.length("p")).alias("b"),
    )
    assert got == {tuple(r) for r in pairs.filter("b > 0 AND d <= b").select("p", "v", "d").collect()}


def test_a_table1_stays_whole_beside_filtered_questions(frame):
    df = frame("Dx, Ward", [("UTI", "A"), ("flu", "A"), ("UTI", "B"), (None, "B")])
    stages = (equals("Ward", "A"),)
    alone = Question("table1", stages=stages, columns=("Dx",))
    grouped = [Question("count", stages=stages, group="Dx"), Question("top", stages=stages, target="Dx")]
    answers = answer_all({"t": df}, [alone, *grouped], "row_id")
    assert [tuple(r) for r in answers[0].collect()] == [tuple(r) for r in answer({"t": df}, alone, "row_id").collect()]
    assert sum(r["n"] for r in answers[1].collect()) == 2
    answers.release()
