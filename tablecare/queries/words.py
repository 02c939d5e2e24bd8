"""Phrases against cell values."""

from __future__ import annotations

from ..operators import matching
from .base import table

PHRASES = ["ring", "small rings", "r", "gear hot", "e coli", "widget blue", "gizmos"]
TYPOS = ["smal", "widgat", "gizom", "boltt", "rign", "blue bolt", "hto"]
COLUMNS = ["p_name", "p_type", "p_brand"]


def _index(spark, folder):
    return matching.value_index(table(spark, folder, "part"), COLUMNS)


def value_candidates(spark, folder):
    return matching.value_candidates(_index(spark, folder), PHRASES)


def value_candidates_top(spark, folder):
    return matching.value_candidates(_index(spark, folder), PHRASES, n=3)


def typo_candidates(spark, folder):
    return matching.typo_candidates(_index(spark, folder), TYPOS)


def nearest_values(spark, folder):
    return matching.nearest_values(_index(spark, folder), COLUMNS, ["brand ring", "small p", "hotter bolts", "xyz"], n=4)


def column_by_vocab(spark, folder):
    vocabulary = table(spark, folder, "part").selectExpr("explode(split(p_name, ' ')) AS word").unionByName(
        table(spark, folder, "part").selectExpr("p_type AS word")
    ).distinct()
    return matching.columns_by_vocabulary(_index(spark, folder), vocabulary)


QUERIES = {
    "value_candidates": value_candidates, "value_candidates_top": value_candidates_top, "typo_candidates": typo_candidates,
    "nearest_values": nearest_values, "column_by_vocab": column_by_vocab,
}

_INDEX = (
    "idx AS (SELECT 'p_name' AS \"column\", min(p_name) AS value FROM part GROUP BY lower(p_name) UNION ALL "
    "SELECT 'p_type', min(p_type) FROM part GROUP BY lower(p_type) UNION ALL SELECT 'p_brand', min(p_brand) FROM part GROUP BY lower(p_brand)), "
    "v AS (SELECT *, list_filter(regexp_split_to_array(lower(value), '[^a-z0-9]+'), lambda x: x <> '') AS t FROM idx)"
)


def _asked(phrases):
    return "q AS (SELECT p AS phrase, list_filter(regexp_split_to_array(lower(p), '[^a-z0-9]+'), lambda x: x <> '') AS q FROM (VALUES " + ", ".join(
        f"('{p}')" for p in phrases) + ") AS s(p))"


_FORM = "lambda w: CASE WHEN len(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN substr(w, 1, len(w) - 1) ELSE w END"
_ALL_WHOLE = "len(list_filter({q}, lambda x: NOT list_contains({t}, x))) = 0"
_ALL_PREFIX = "len(list_filter(q, lambda x: len(list_filter(t, lambda y: starts_with(y, x))) = 0)) = 0"
_SCORED = (
    f"WITH {_INDEX}, {_asked(PHRASES)}, f AS (SELECT *, list_transform(q, {_FORM}) AS qf, list_transform(t, {_FORM}) AS tf FROM q, v), "
    f"s AS (SELECT phrase, \"column\", value, CASE WHEN {_ALL_WHOLE.format(q='q', t='t')} THEN CASE WHEN len(q) = len(t) THEN 3.0 ELSE 2.0 END "
    f"WHEN {_ALL_PREFIX} THEN 1.0 WHEN (q <> qf OR t <> tf) AND {_ALL_WHOLE.format(q='qf', t='tf')} THEN 0.5 END AS score FROM f) "
    "SELECT phrase, \"column\", value, CAST(score AS DOUBLE) AS score, score = 3 AS exact FROM s WHERE score IS NOT NULL"
)
_FOLD = "replace(replace(replace({w}, 'ae', 'e'), 'oe', 'e'), 'll', 'l')"

SQL = {
    "value_candidates": _SCORED,
    "value_candidates_top": f"SELECT phrase, \"column\", value, score, exact FROM (SELECT *, row_number() OVER (PARTITION BY phrase "
    f"ORDER BY score DESC, len(value), value, \"column\") AS rn FROM ({_SCORED})) WHERE rn <= 3",
    "typo_candidates": (
        f"WITH {_INDEX}, {_asked(TYPOS)}, w AS (SELECT \"column\", value, {_FOLD.format(w='unnest(t)')} AS w FROM v), "
        f"a AS (SELECT phrase, {_FOLD.format(w='q[1]')} AS a, CASE WHEN len(q[1]) < 4 THEN 0 WHEN len(q[1]) <= 6 THEN 1 ELSE 2 END AS budget FROM q WHERE len(q) = 1) "
        "SELECT phrase, \"column\", value, min(levenshtein(a, w)) AS distance FROM a, w WHERE budget > 0 AND levenshtein(a, w) <= budget GROUP BY 1, 2, 3"
    ),
    "nearest_values": (
        f"WITH {_INDEX}, {_asked(['brand ring', 'small p', 'hotter bolts', 'xyz'])}, "
        "targets AS (SELECT 'value' AS kind, \"column\", value, t FROM v UNION ALL SELECT 'column', c, c, string_split(c, '_') "
        "FROM (VALUES ('p_name'), ('p_type'), ('p_brand')) AS s(c)), "
        "o AS (SELECT phrase, kind, \"column\", value, len(list_filter(q, lambda x: len(list_filter(t, lambda y: starts_with(y, x) OR starts_with(x, y))) > 0)) AS overlap FROM q, targets) "
        "SELECT phrase, kind, \"column\", value, overlap FROM (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY overlap DESC, len(value), kind, value, \"column\") AS rn "
        "FROM o WHERE overlap > 0) WHERE rn <= 4"
    ),
    "column_by_vocab": (
        f"WITH {_INDEX}, words AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) "
        "UNION SELECT DISTINCT lower(p_type) FROM part), "
        "e AS (SELECT \"column\", value, unnest(t) AS x FROM v), "
        "h AS (SELECT \"column\", value, bool_or(x IN (SELECT w FROM words)) AS hit FROM e GROUP BY 1, 2) "
        "SELECT \"column\", count_if(hit) AS matched, count(*) AS total FROM h GROUP BY 1 HAVING count_if(hit) / count(*) >= 0.6"
    ),
}
