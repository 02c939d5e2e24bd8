"""Specs, replay, codes, report cards, masked samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.conditions import equals, one_of, threshold
from ..operators.datasets import categorical
from ..operators.fixes import Fix
from ..plans import codes as coding
from ..plans.masked_sample import masked_sample
from ..plans.question import Measure, Question, absent_values, answer, answer_all
from ..plans.recipe import (
    Recipe, deidentify_step, fix_step, question_step, report_cards_step, run_transform, transform_step,
)
from ..plans.replay import replay
from ..plans.report_cards import bars, report_cards
from .base import blank, derived, fold, num, pct, r2, table, trim, with_tables

CUSTOMERS, ORDERS = "messy_customer", "messy_orders"


def _tables(spark, folder):
    return {"orders": derived(spark, folder, ORDERS), "customers": derived(spark, folder, CUSTOMERS)}


def pipeline_answer(spark, folder):
    spec = Question(intent="average", stages=(equals("status", "F"),), group="priority", target="amount", table="orders")
    return answer(_tables(spark, folder), Question.from_json(spec.to_json()), "row_id").drop("first")


def pipeline_measure(spark, folder):
    spec = Measure("median", "amount", (((("status", "F")),), ((("tags", "blue")),)), ("status", "tags"), ("median", True), "orders")
    return answer(_tables(spark, folder), spec, "row_id")


def pipeline_compound(spark, folder):
    """Two questions over one shared filter."""
    shared = (one_of("status", ["F", "O"]), threshold("amount", ">", 10))
    first, second = answer_all(_tables(spark, folder), [
        Question(intent="top", stages=shared, target="priority", n=3, table="orders"),
        Question(intent="count", stages=shared, group="tags", table="orders"),
    ], "row_id")
    part = lambda d, name: d.select(F.lit(name).alias("answer"), "label", "n", "share_pct")
    return part(first, "top").unionByName(part(second, "share"))


def user_transform(spark, folder):
    def busiest(tables):
        return tables["orders"].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 15")

    return run_transform(busiest, {"orders": table(spark, folder, "orders")})


def single_filter(spark, folder):
    return categorical(derived(spark, folder, ORDERS), "status", "row_id", chosen=("priority", "2-HIGH")).points.select("label", "value")


def absent(spark, folder):
    q = Question(stages=(equals("status", "f"), equals("status", "Z"), one_of("priority", ["9-none", "8-none"]), one_of("tags", ["blue", "x"])))
    return absent_values(derived(spark, folder, ORDERS), q)


def _known_codes(spark, folder):
    """Codes kept from an earlier run: every third doctor."""
    return table(spark, folder, "customer").selectExpr("c_custkey % 97 AS k").filter("k % 3 = 0").distinct().selectExpr(
        "concat('Dr ', k) AS name", "concat('Prescriber ', k + 1) AS code", "k + 1 AS seq"
    )


def _coded(spark, folder):
    return coding.deidentify(derived(spark, folder, CUSTOMERS), "doctor", "row_id", _known_codes(spark, folder), "Prescriber")


def deidentify(spark, folder):
    return _coded(spark, folder).rows.select("row_id", "doctor")


def new_codes(spark, folder):
    return _coded(spark, folder).new


def person_codes(spark, folder):
    return _coded(spark, folder).codes


def _cards(spark, folder):
    """Doctors grouped by nation and balance band, so that some groups are small."""
    df = derived(spark, folder, CUSTOMERS).withColumn("ward", F.concat_ws("-", "nation", F.floor(F.col("balance") / 4000).cast("string")))
    return report_cards(df, "doctor", "balance", "ward")


def report_cards_query(spark, folder):
    return _cards(spark, folder).cards.select(
        "person", "group", F.round("value", 2).alias("value"), "group_size", F.round("group_max", 2).alias("group_max"), "small_cell"
    )


def report_card_warnings(spark, folder):
    return _cards(spark, folder).warnings


def report_card_bars(spark, folder):
    return bars(_cards(spark, folder), ["Dr 5", "Dr 17"]).withColumn("value", F.round("value", 2))


def _recipe():
    """Recorded on an earlier delivery, with some columns since renamed or gone."""
    recipe = Recipe("monthly")
    for step in [
        fix_step(Fix("merge_spellings", "Segment", {"map": {"building": "BUILDING", " BUILDING": "BUILDING"}})),
        fix_step(Fix("number_text", "Dose")), fix_step(Fix("dedupe_rows")),
        question_step("how many", Question(stages=(equals("Segment", "building"), equals("nation", "Atlantis")))),
        transform_step("positive", lambda t: t["table"].filter("balance > 0")),
        deidentify_step("Doctor"), report_cards_step("doctor", "Weight", "c_nationkey"),
    ]:
        recipe = recipe.add(step)
    return recipe


def _replayed(spark, folder):
    df = derived(spark, folder, CUSTOMERS)
    return replay(_recipe(), df, "row_id", _known_codes(spark, folder), "Prescriber")


def replay_steps(spark, folder):
    return _replayed(spark, folder).steps


def replay_surprises(spark, folder):
    return _replayed(spark, folder).surprises


def replay_answers(spark, folder):
    return _replayed(spark, folder).answers["how many"].select("stage", "matched", "out_of")


def replay_rows(spark, folder):
    return _replayed(spark, folder).rows.select("row_id", "segment", "doctor")


def replay_cards(spark, folder):
    return _replayed(spark, folder).cards.cards.select("person", "group", "value", "group_size")


def masked_rows(spark, folder):
    return masked_sample(derived(spark, folder, CUSTOMERS), "row_id", withheld=["doctor"])


def masked_shape(spark, folder):
    """What a masked sample keeps of the first rows: letters stay letters, digits digits, and withheld cells say so."""
    shown = masked_rows(spark, folder)
    shape = lambda c: F.regexp_replace(F.regexp_replace(c, "[A-Za-z]", "a"), "[0-9]", "9")
    return shown.select(
        shape(F.col("segment")).alias("segment"), shape(F.col("nation")).alias("nation"), "doctor", F.col("balance").isNull().alias("no_balance"),
    )


QUERIES = {
    "masked_sample_shape": masked_shape,
    "pipeline_answer": pipeline_answer, "pipeline_measure": pipeline_measure, "pipeline_compound": pipeline_compound,
    "user_transform": user_transform, "single_filter": single_filter, "absent_values": absent, "deidentify": deidentify,
    "new_codes": new_codes, "person_codes": person_codes, "report_cards": report_cards_query,
    "report_card_warnings": report_card_warnings, "report_card_bars": report_card_bars, "replay_steps": replay_steps,
    "replay_surprises": replay_surprises, "replay_answers": replay_answers, "replay_rows": replay_rows,
    "replay_cards": replay_cards, "masked_sample": masked_rows,
}

# --- the same in SQL ---------------------------------------------------------------------------

_SHARED = f"(SELECT * FROM messy_orders WHERE status IN ('F', 'O') AND coalesce({num('amount')} > 10, false))"


def _counts(column):
    return f"SELECT arg_min({column}, row_id) AS label, count(*) AS n FROM {_SHARED} WHERE NOT {blank(column)} GROUP BY {fold(column)}"


_KNOWN = (
    "known AS (SELECT DISTINCT 'Dr ' || CAST(c_custkey % 97 AS VARCHAR) AS name, 'Prescriber ' || CAST(c_custkey % 97 + 1 AS VARCHAR) AS code, "
    "c_custkey % 97 + 1 AS seq FROM customer WHERE (c_custkey % 97) % 3 = 0)"
)


def _codes(source):
    return (
        f"{_KNOWN}, fresh AS (SELECT name, row_number() OVER (ORDER BY first) + (SELECT max(seq) FROM known) AS seq FROM "
        f"(SELECT {trim('doctor')} AS name, min(row_id) AS first FROM {source} WHERE NOT {blank('doctor')} GROUP BY 1) "
        "WHERE name NOT IN (SELECT name FROM known)), "
        "new AS (SELECT name, 'Prescriber ' || CASE WHEN seq < 10 THEN '0' ELSE '' END || CAST(seq AS VARCHAR) AS code, seq FROM fresh), "
        "every AS (SELECT * FROM known UNION ALL SELECT * FROM new)"
    )


_TOTALS = f"totals AS (SELECT doctor AS person, nation || '-' || CAST(CAST(floor(balance / 4000) AS BIGINT) AS VARCHAR) AS grp, sum(balance) AS value FROM messy_customer WHERE NOT {blank('doctor')} GROUP BY 1, 2)"
_MERGED = "CASE WHEN segment IN ('building', ' BUILDING') THEN 'BUILDING' ELSE segment END"
_REPLAY = (
    f", m AS (SELECT * REPLACE ({_MERGED} AS segment) FROM messy_customer), "
    "d AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY segment, nation, doctor, balance, c_nationkey ORDER BY row_id) AS rn FROM m) WHERE rn = 1), "
    "p AS (SELECT * FROM d WHERE balance > 0), "
)
_CODED = (
    f"coded AS (SELECT p.* REPLACE (coalesce(every.code, p.doctor) AS doctor) FROM p LEFT JOIN every ON every.name = {trim('p.doctor')})"
)


def _step(i, label, skipped, note, before, after, changed="0"):
    return (
        f"SELECT {i} AS step, '{label}' AS label, {skipped} AS skipped, {note} AS note, (SELECT count(*) FROM {before}) AS rows_before, "
        f"(SELECT count(*) FROM {after}) AS rows_after, CAST({changed} AS BIGINT) AS cells_changed"
    )


_VARIANTS = (
    f"SELECT segment FROM (SELECT segment, count(*) OVER (PARTITION BY k) AS spellings FROM (SELECT DISTINCT segment, {fold('segment')} AS k FROM m "
    f"WHERE NOT {blank('segment')})) WHERE spellings > 1"
)

_SHAPE = "regexp_replace(regexp_replace({0}, '[A-Za-z]', 'a', 'g'), '[0-9]', '9', 'g') AS {0}"

SQL = {
    "masked_sample_shape": with_tables(
        f"SELECT {_SHAPE.format('segment')}, {_SHAPE.format('nation')}, '[withheld]' AS doctor, balance IS NULL AS no_balance "
        "FROM (SELECT * FROM messy_customer ORDER BY row_id LIMIT 10)", CUSTOMERS),
    "pipeline_answer": with_tables(
        f"SELECT arg_min(priority, row_id) AS label, count(*) AS rows, count(x) AS n, count(*) - count(x) AS skipped, {r2('avg(x)')} AS average FROM "
        f"(SELECT *, {num('amount')} AS x FROM messy_orders WHERE status = 'F' AND NOT {blank('priority')}) GROUP BY {fold('priority')}", ORDERS),
    "pipeline_measure": with_tables(
        f"SELECT status, tags, {r2('quantile_cont(x, 0.5)')} AS median FROM (SELECT *, {num('amount')} AS x FROM messy_orders "
        f"WHERE (status = 'F' OR {fold('tags')} = 'blue') AND NOT {blank('tags')}) GROUP BY 1, 2", ORDERS),
    "pipeline_compound": with_tables(
        f"SELECT 'top' AS answer, label, n, {pct('n', 'd')} AS share_pct FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS rk, sum(n) OVER () AS d FROM "
        f"({_counts('priority')})) WHERE rk <= 3 UNION ALL SELECT 'share', label, n, {pct('n', f'(SELECT count(*) FROM {_SHARED})')} FROM ({_counts('tags')})", ORDERS),
    "user_transform": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15",
    "single_filter": with_tables(
        f"SELECT status AS label, CAST(count(*) AS DOUBLE) AS value FROM messy_orders WHERE {fold('priority')} = '2-high' GROUP BY 1", ORDERS),
    "absent_values": "SELECT 'status' AS \"column\", 'Z' AS value WHERE (SELECT count(*) FROM orders WHERE lower(o_orderstatus) = 'z') = 0 "
    "UNION ALL SELECT 'priority', '9-none, 8-none'",
    "deidentify": with_tables(
        f", {_codes(CUSTOMERS)} SELECT row_id, coalesce(code, doctor) AS doctor FROM messy_customer LEFT JOIN every ON name = {trim('doctor')}", CUSTOMERS),
    "new_codes": with_tables(f", {_codes(CUSTOMERS)} SELECT name, code, seq FROM new", CUSTOMERS),
    "person_codes": with_tables(f", {_codes(CUSTOMERS)} SELECT name, code, seq FROM every", CUSTOMERS),
    "report_cards": with_tables(
        f", {_TOTALS} SELECT person, grp AS \"group\", round(value, 2) AS value, count(*) OVER w AS group_size, round(max(value) OVER w, 2) AS group_max, "
        "count(*) OVER w <= 2 AS small_cell FROM totals WINDOW w AS (PARTITION BY grp)", CUSTOMERS),
    "report_card_warnings": with_tables(
        f", {_TOTALS} SELECT grp AS \"group\", count(*) AS people FROM totals GROUP BY 1 HAVING count(*) <= 2", CUSTOMERS),
    "report_card_bars": with_tables(
        f", {_TOTALS} SELECT s.person AS subject, s.grp AS \"group\", p.person AS label, round(p.value, 2) AS value, p.person = s.person AS is_subject "
        "FROM totals s JOIN totals p USING (grp) WHERE s.person IN ('Dr 5', 'Dr 17')", CUSTOMERS),
    "replay_steps": with_tables(_REPLAY + _codes("p") + " " + " UNION ALL ".join([
        _step(0, "merge_spellings(Segment)", "false", "NULL", "m", "m", "(SELECT count_if(segment IN ('building', ' BUILDING')) FROM messy_customer)"),
        _step(1, "number_text(Dose)", "true", "'skipped'", "m", "m"), _step(2, "dedupe_rows", "false", "NULL", "m", "d"),
        _step(3, "how many", "false", "NULL", "d", "d"), _step(4, "positive", "false", "NULL", "d", "p"),
        _step(5, "codes for Doctor", "false", "NULL", "p", "p"), _step(6, "report cards per doctor", "false", "NULL", "p", "p"),
    ]), CUSTOMERS),
    "replay_surprises": with_tables(
        _REPLAY + _codes("p") + f", {_CODED} SELECT 0 AS step, 'newCategoryVariant' AS type, 'segment' AS \"column\", segment AS detail FROM ({_VARIANTS}) UNION ALL "
        "SELECT 1, 'missingColumn', 'Dose', 'no column matches Dose' UNION ALL SELECT 3, 'missingValue', 'nation', 'Atlantis' UNION ALL "
        "SELECT 5, 'newPerson', 'doctor', code FROM new UNION ALL SELECT 6, 'missingColumn', 'Weight', 'no column matches Weight' UNION ALL "
        f"SELECT 6, 'smallCell', 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM coded WHERE NOT {blank('doctor')} GROUP BY c_nationkey HAVING count(DISTINCT doctor) <= 2",
        CUSTOMERS),
    "replay_answers": with_tables(
        _REPLAY + f"b AS (SELECT count_if({fold('segment')} = 'building') AS n, count(*) AS total FROM d) "
        "SELECT 1 AS stage, n AS matched, total AS out_of FROM b UNION ALL SELECT 2, 0, n FROM b", CUSTOMERS),
    "replay_rows": with_tables(_REPLAY + _codes("p") + f", {_CODED} SELECT row_id, segment, doctor FROM coded", CUSTOMERS),
    "replay_cards": with_tables(
        _REPLAY + _codes("p") + f", {_CODED}, t AS (SELECT doctor AS person, CAST(c_nationkey AS VARCHAR) AS grp, CAST(count(*) AS DOUBLE) AS value "
        f"FROM coded WHERE NOT {blank('doctor')} GROUP BY 1, 2) SELECT person, grp AS \"group\", value, count(*) OVER (PARTITION BY grp) AS group_size FROM t", CUSTOMERS),
}
