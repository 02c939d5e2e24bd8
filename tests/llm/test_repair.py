from __future__ import annotations

import hashlib
import random
from functools import lru_cache

import pytest

from tablecare.llm import repair as r

MOVES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
NAMES = {"u": "user", "a": "assistant"}


def plain_repair(rows):
    """(faults, cost, audit, repaired) of ordered (role, text) rows, by trying every edit in every place."""
    seen, faults = set(), []
    for role, text in rows:
        said = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)

    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(rows) and state in (0, 3):
            found.append((0, "", ()))
        if inserted < 4:
            for c, to in MOVES[state].items():
                if c in NAMES:
                    cost, audit, left = best(i, to, inserted + 1)
                    found.append((cost + 5, "I" + audit, (NAMES[c] + ":", *left)))
        if i < len(rows):
            role, text = rows[i]
            cost, audit, left = best(i + 1, state, 0)
            found.append((cost + 2, "D" + audit, left))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 if faults[i] == "truncated" else 0
                for c, to in MOVES[state].items():
                    cost, audit, left = best(i + 1, to, 0)
                    if role[:1] == c:
                        found.append((cost + more, "K" + audit, (f"{role}:{text}", *left)))
                    if c in NAMES:
                        found.append((cost + more + 1, "R" + audit, (f"{NAMES[c]}:{text}", *left)))
        return min(found) if found else (10**9, "", ())

    cost, audit, left = best(0, 0, 0)
    return faults, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest()


def plain_row(rows):
    """The summary of one conversation of (turn, role, text), nulls as stated."""
    rows = [(t, " " if role is None else role, " " if text is None else text) for t, role, text in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    faults, cost, audit, digest = plain_repair([x[1:] for x in rows])
    turns = [x[0] for x in rows if x[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, digest)


ROLES = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "assist"]
TEXTS = ["Yes.", "No!", "Why?", "cut", "cut off ", "", " \t\n", None, "ok.\n", "a. b", " ", "é.", "one.", "two.", "three.", "four."]


def random_rows(rng, n):
    roles = ROLES if rng.random() < 0.5 else ["user", "assistant"]
    texts = TEXTS if rng.random() < 0.5 else [f"text {i}." for i in range(50)] + ["cut"]
    return [(rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def got_rows(spark, told, segment):
    done = r.repair(spark.createDataFrame([(k, *x) for k, rows in told.items() for x in rows], "conv_id long, turn long, role string, text string").repartition(5), segment=segment)
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    out = {x["conv"]: tuple(x[c] for c in names) for x in done.summary.collect()}
    empty = hashlib.sha256(b"").hexdigest()
    digests = {x["conv"]: x["digest"] for x in done.digests().collect()}
    return {k: (*v, digests.get(k, empty)) for k, v in out.items()}


@pytest.mark.parametrize("segment", [3, 1 << 16])
def test_against_every_edit(spark, segment):
    rng = random.Random(segment)
    told = {k: random_rows(rng, rng.choice([1, 2, 3, 5, 8, 13])) for k in range(120)}
    told[None] = random_rows(rng, 9)
    told[500] = [(i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(60)]
    told[501] = [(0, "user", "again.")] * 40 + [(1, "assistant", "yes.")] * 3 + [(2, "assistant", "")] * 4
    assert got_rows(spark, told, segment) == {k: plain_row(v) for k, v in told.items()}


def test_a_long_conversation_over_many_segments(spark):
    rng = random.Random(4)
    told = {7: [(i, rng.choice(["user", "assistant", "system"]), rng.choice([f"text {i}.", f"text {i}.", "cut", ""])) for i in range(150)]}
    assert got_rows(spark, told, 16) == {7: plain_row(told[7])}


def test_checkpoints_and_matrices_agree_with_one_pass():
    rng = random.Random(8)
    rows = [(rng.choice("suax"), rng.choice([r.FINE, r.FINE, r.SHORT, r.GONE]), rng.choice([1, 1, 1, 3])) for _ in range(3000)]
    vector = r.END
    for row in reversed(rows):
        vector = r.vector_before(row, vector)
    walk = r.walks(rows, r.END, (0,))[0]
    walk.finish()
    assert walk.cost == vector[0]
    parts = [rows[i : i + 700] for i in range(0, 3000, 700)]
    ends, audit, state = r.vectors_at_ends([r.matrix(p) for p in parts]), "", 0
    for part, end in zip(parts, ends):
        step = r.walks(part, end, (state,))[0]
        if part is parts[-1]:
            step.finish()
        audit, state = audit + "".join(step.edits), step.state
    assert audit == "".join(walk.edits)


def test_clashing_columns_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string, n string, part string, edits string, digest string"
    rows = [(1, 0, "user", "Hi.", *["x"] * 4), (1, 1, "assistant", "Hello.", *["x"] * 4)]
    done = r.repair(spark.createDataFrame(rows, schema))
    assert [x["audit"] for x in done.summary.collect()] == ["KK"]
    assert sorted(x["text"] for x in done.texts().collect()) == ["Hello.", "Hi."]
    none = r.repair(spark.createDataFrame([], schema))
    assert none.summary.count() == 0 and none.digests().count() == 0
