from __future__ import annotations

import random
import re
import string

import pytest

from tablecare.llm import secrets as s


def brute(text):
    out = []
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    out += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


def test_base_spans_against_plain_patterns():
    rng = random.Random(1)
    pieces = ["password", "passWD", "Secret", "TOKEN", "api_key", "apikey", "toKen", ":", "=", " ", '"', "'", "abc", "abcdefgh", "0123456789abcdef", "AKIA", "ABCDEF123456", "é", "\n", "-", "."]
    for _ in range(4000):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 14)))
        assert s.base_spans(text) == brute(text), text


@pytest.mark.parametrize("token", [
    "Donaudampfschifffahrtsgesellschaft", "getUserNameByIdentifierString", "some-very-long-slug-name-here", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "abcdefghijklmnopqrstuvwxyz0123456789", "00000000000000000000000a", "--------------------", "abababababababababababab", "AAAAAAAAAAbbbbbbbbbb1111111111",
])
def test_ordered_and_worded_tokens_are_not_random(token):
    assert s.level_of(s.battery(token)[1]) < 100


def test_digits_and_padding_have_no_alphabet():
    assert s.battery("1234567890" * 3) is None and s.battery("=" * 40) is None


@pytest.mark.parametrize("symbols", [
    string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase + "234567", string.ascii_lowercase,
])
def test_random_tokens_of_one_case_are_not_refused_for_their_alphabet(symbols):
    rng = random.Random(11)
    refused = sum(s.battery("".join(rng.choices(symbols, k=80)))[1] == 1.0 for _ in range(200))
    assert refused <= 4


def test_tokens_are_cut_at_separators_and_inner_equal_signs():
    rng = random.Random(12)
    body = "".join(rng.choices(string.ascii_lowercase + string.digits, k=40))
    mixed = "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    for text, a, b in [
        (f"AWS_KEY={mixed}==", 8, 50), (f"prod-live_{body}", 10, 50), (f"a-path/{mixed}/with-more", 2, 52), (f"{mixed}", 0, 40), ("aB3xY9kQ2mZ7pR4t", 0, 16),
    ]:
        found = [t for t in s.tested_tokens(text, []) if t[4] > 100]
        assert [t[:2] for t in found] == [(a, b)], text


def docs_with(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, spans string").repartition(4)


def test_random_tokens_are_found_among_words(spark):
    rng = random.Random(2)
    words = ["".join(rng.choices("etaoinshrdlu", weights=[12, 9, 8, 7, 7, 6, 6, 6, 5, 4, 4, 3], k=rng.randint(20, 34))) for _ in range(400)]
    secrets = ["".join(rng.choices(string.ascii_letters + string.digits + "+/", k=rng.choice([32, 40, 64]))) for _ in range(40)]
    rows = [(i, f"é {w} then", None) for i, w in enumerate(words)]
    rows += [(1000 + i, f"see {x}, ok", None) for i, x in enumerate(secrets)]
    rows += [(3000, f'password="{secrets[0]}"', None), (3001, None, None), (3002, "", None), (None, secrets[1], None), (7, "same", None), (7, "same", None)]
    got = {r["doc_id"]: (r["base"], [(x["start"], x["kind"], x["end"]) for x in r["spans"]]) for r in s.find_secrets(docs_with(spark, rows), ["doc_id"]).collect()}
    assert sum(len(got[i][1]) for i in range(len(words))) <= 1
    found = [got[1000 + i][1] == [(4, 3, 4 + len(x))] for i, x in enumerate(secrets)]
    assert sum(found) >= 36
    assert got[3000][1] == [(0, 0, 10 + len(secrets[0]))] and got[3001] == ([], []) and got[3002] == ([], [])
    assert got[None][1] == [(0, 3, len(secrets[1]))]


def test_false_discovery_level_per_band(spark):
    rows = [([{"start": 0, "end": 20, "alphabet": "hex", "band": 20, "level": v}],) for v in [300, 300, 0, 0, 0, 0, 0, 0, 0, 0]]
    scanned = spark.createDataFrame(rows, f"tested array<struct<{s.TOKEN.replace(' ', ':').replace(',:', ',')}>>")
    assert s.discovery_levels(scanned)[20] == 300
    assert s.discovery_levels(scanned)[32] == s.LEVELS + 1


def test_empty_table(spark):
    assert s.find_secrets(docs_with(spark, []), ["doc_id"]).count() == 0


def test_the_cut_with_the_most_random_part_is_chosen():
    rng = random.Random(11)
    letters = string.ascii_letters + string.digits
    for prefix in ("internationalization-", "configurationmanager-"):
        exact = 0
        for _ in range(40):
            text = prefix + "".join(rng.choice(letters) for _ in range(40))
            found = s.tested_tokens(text, [])
            ps = [s.battery(text[a:b])[1] for cut in s.CUTS for a, b in [m.span() for m in cut.finditer(text)] if b - a >= s.LEAST and s.battery(text[a:b])]
            assert min(s.battery(text[a:b])[1] for a, b, *_ in found) == min(ps)
            exact += (len(prefix), len(text)) in [(a, b) for a, b, *_ in found]
        assert exact >= 30
