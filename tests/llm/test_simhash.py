from __future__ import annotations

import random

import numpy as np

import pytest
from xxhash import xxh64_intdigest

from tablecare.llm import simhash as s


def plain_split(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        lowered = lowered.replace(c, " ")
    return [w for w in lowered.split(" ") if w]


def plain_fingerprint(text):
    words = plain_split(text)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return s._signed(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))


def plain_roots(fps, limit=4):
    fps = sorted(set(fps))
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= limit:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", [
    None, "", " \n\t", "One", "a b", "a b c d", "A\x0bB\x0cc d e", "ÄÖ x\x85y z\xa0w q r", "a a a a a a a", "é " * 300, "w1 w2 w3 w4 w5 " * 20_000,
])
def test_fingerprint(text):
    assert s.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("limit, blocks", [(4, 6), (4, 5), (4, 4), (3, 5), (5, 7)])
def test_lookups_meet_every_close_pair(limit, blocks):
    rng = random.Random(9)
    masks, lookups = s.segments(limit, blocks)
    assert sum(s.block_masks(blocks)) == 2**64 - 1
    for _ in range(1500):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << bit for bit in rng.sample(range(64), rng.randint(0, limit)))
        assert any(not x & f and (x & masks[i]) ^ f == y & masks[i] for i, f in lookups for x, y in ((a, b), (b, a)))


def clustered(rng, clusters, size):
    out = []
    for _ in range(clusters):
        f = rng.getrandbits(64)
        for _ in range(size):
            for b in rng.sample(range(64), rng.randint(0, 5)):
                f ^= 1 << b
            out.append(s._signed(f))
    return out + [s._signed(rng.getrandbits(64)) for _ in range(200)] + [0, -1]


def test_classes_against_all_pairs(spark):
    fps = clustered(random.Random(3), 12, 40)
    got = {r["fp"]: r["root"] for r in s.classes_of(spark.createDataFrame([(f,) for f in fps + fps[:50]], "fp long").repartition(5)).collect()}
    assert got == plain_roots(fps)


def test_the_search_alone_finds_all(spark):
    fps = sorted(set(clustered(random.Random(8), 8, 25)))
    links = {tuple(sorted(r)) for r in s.searched_links(spark.createDataFrame([(f, f) for f in fps], "fp long, root long")).collect()}
    wanted = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    assert links == wanted


def test_one_group_of_near_copies_is_passed_over(spark):
    base, rng = random.Random(6).getrandbits(64), random.Random(7)
    near = sorted({s._signed(base ^ (1 << a) ^ (1 << b)) for a in range(64) for b in range(a)} | {s._signed(base)})
    done = spark.createDataFrame([(f, near[0]) for f in near], "fp long, root long")
    assert s.searched_links(done).count() == 0
    rng.shuffle(near)
    assert {r["root"] for r in s.classes_of(spark.createDataFrame([(f,) for f in near], "fp long")).collect()} == {min(near)}


ROWS = [
    (5, "the same words in this text stand here twice", "a"), (3, "the same words in this text stand here twice", "b"),
    (3, "the same words in this text stand here twice", "b"), (None, "the same words in this text stand here twice", "c"),
    (None, "alone", "d"), (9, None, "e"), (8, "", "f"), (7, "quite another line of words that is by itself", "g"),
]


def test_groups_and_representatives(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, fp string").repartition(3)
    got = sorted([(r["doc_id"], r["group"]) for r in s.groups(df).collect()], key=repr)
    assert got == sorted([(5, 3), (3, 3), (3, 3), (None, 3), (None, None), (9, 8), (8, 8), (7, 7)], key=repr)
    kept = sorted([tuple(r) for r in s.keep_one(df).collect()], key=repr)
    assert kept == sorted([ROWS[1], ROWS[4], ROWS[6], ROWS[7]], key=repr)
    assert s.groups(df.limit(0)).count() == 0 and s.keep_one(df.limit(0)).columns == ["doc_id", "text", "fp"]


def test_components_of_a_long_chain_and_a_hub(spark):
    from tablecare.llm.components import connected

    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(1000, 1400)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long").repartition(4)).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(1000, 1400)}


def test_similar_texts_against_all_pairs(spark):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
    texts += ["", " \t", "a b", "A  B", "a b c d e", "a b c d e f"] + [" ".join(rng.choice(words) for _ in range(100)) for _ in range(40)]
    sets = [set(zip(*[plain_split(t)[i:] for i in range(5)])) or ({tuple(plain_split(t))} if plain_split(t) else set()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(500 + i, texts[i], "x") for i in range(9)] + [(3, texts[3], "x"), (None, texts[5], "x"), (None, None, "x")]
    kept = {r["doc_id"] for r in s.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(4)).collect()}
    wanted = {group.index(g) for g in group}
    # Links are exact; candidates are found with a probability near 1 for texts this close.
    assert wanted <= kept and len(kept - wanted) <= 1
    assert s.keep_one_similar(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert s.similarity("a b c d e f", "a b c d e") == 0.5 and s.similarity("", None) == 1.0


def test_one_large_group_among_strangers_costs_members_times_roots(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(5)]
    rows = [(i, 0, *[s._signed(w ^ (1 << rng.randrange(64))) for w in base]) for i in range(2000)]
    rows += [(5000 + i, 5000 + i, *[s._signed(w) for w in base[:4]], s._signed(rng.getrandbits(64))) for i in range(20)]
    rooted = spark.createDataFrame(rows, "node long, root long, " + ", ".join(f"w{i} long" for i in range(5)))
    pairs = s.met_in_segments(rooted)
    assert pairs.count() <= 2000 * 20 + 20 * 20 * 24


def test_a_large_group_with_strangers_in_its_buckets_is_compared_with_these_only(spark, monkeypatch):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    group = sorted({s._signed(base ^ (1 << a) ^ (1 << b)) for a in range(64) for b in range(a)})
    strangers = []
    for i in range(20):
        other = rng.getrandbits(64)
        mask = s.segments()[0][i]
        strangers.append(s._signed((other & ~mask) | (base & mask)))
    classes = spark.createDataFrame([(f, group[0]) for f in group] + [(f, f) for f in strangers], "fp long, root long")
    # Every stranger shares one segment with the whole group.  Pairs of the group alone would be two million a table.
    assert s.compared(classes).count() < 3 * 20 * len(group) * 10
    assert s.searched_links(classes).count() == 0


def test_no_link_at_the_threshold_is_left_out(spark):
    rng = random.Random(21)
    rows = []
    for i in range(150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(148)]
        near = list(base)
        # 144 shingles, 16 of which differ on each side: exactly 0.8 of all in common.
        for at in (20, 60, 100):
            near[at] = "x" + near[at]
        near[147] = "x" + near[147]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(near))]
    assert all(s.similarity(a, b) == 0.8 for (_, a), (_, b) in zip(rows[::2], rows[1::2]))
    kept = {r["doc_id"] for r in s.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert kept == set(range(0, 300, 2))


def test_texts_below_the_threshold_are_refused_before_their_texts_are_read(spark, monkeypatch):
    rng = random.Random(22)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(0, 150, 5), 6):
            words[at] = f"y{i}x{at}"
        rows.append((i, " ".join(words)))
    pairs = []
    confirmed = s.confirmed
    monkeypatch.setattr(s, "confirmed", lambda p, *rest: pairs.append(p.count()) or confirmed(p, *rest))
    assert s.keep_one_similar(spark.createDataFrame(rows, "doc_id long, text string")).count() == 150
    assert sum(pairs) <= 150


def _pairs_read(spark, monkeypatch, texts):
    """The documents kept, and how many pairs of texts were read for it."""
    pairs, confirmed = [], s.confirmed
    monkeypatch.setattr(s, "confirmed", lambda p, *rest: pairs.append(p.count()) or confirmed(p, *rest))
    kept = s.keep_one_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    return sorted(r["doc_id"] for r in kept.collect()), sum(pairs)


def test_long_texts_below_the_threshold_are_refused_by_their_whole_parities(spark, monkeypatch):
    rng = random.Random(23)
    part = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    core, ends = part(1000), [part(500) for _ in range(8)]
    # Each shares three quarters with the next one: similar to 0.6.
    texts = [f"{ends[i]} {core} {ends[(i + 1) % 8]}" for i in range(8)]
    assert _pairs_read(spark, monkeypatch, texts) == (list(range(8)), 0)


def test_a_group_around_one_text_is_joined_by_about_a_pair_a_text(spark, monkeypatch):
    rng = random.Random(24)
    base = [f"w{rng.randrange(10**9)}" for _ in range(204)]
    texts = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(5, 195, 5), 4):
            words[at] = f"y{i}x{at}"
        texts.append(" ".join(words))
    kept, read = _pairs_read(spark, monkeypatch, [*texts, " ".join(base)])
    assert kept == [0] and read <= 2 * len(texts)


def test_parities_never_differ_in_more_bits_than_shingles(spark):
    rng = random.Random(25)
    for n, more in ((0, 3), (5, 0), (300, 40), (700, 500), (3000, 90)):
        x = np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)
        y = np.concatenate([x[n // 9 :], np.array([rng.getrandbits(64) for _ in range(more)], np.uint64)])
        apart = s.bits_apart(s.parity_bits(x).tobytes(), s.parity_bits(y).tobytes())
        assert apart <= n // 9 + more and apart % 2 == (n // 9 + more) % 2


def test_exploded_tables_are_not_sent_to_every_task(spark):
    from tablecare.llm.common import stored

    fps = sorted(set(clustered(random.Random(8), 8, 25)))
    classes = stored(spark.createDataFrame([(f, f) for f in fps], "fp long, root long"))
    met = s.compared(classes)
    assert met.count() > 0
    # Spark sizes a table of 20 or 100 rows a fingerprint as one of a row each: 300,000 fingerprints would fill a driver.
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_fingerprints_connect_what_is_close(spark):
    fps = clustered(random.Random(13), 6, 20)
    nodes = spark.createDataFrame([(i, f) for i, f in enumerate(fps + fps[:30])], "node long, fp long").repartition(4)
    from tablecare.llm.components import connected

    root = {r["node"]: r["root"] for r in connected(s.print_pairs(nodes)).collect()}
    of = plain_roots(fps)
    first = {}
    for i, f in enumerate(fps):
        first.setdefault(of[f], i)
    assert [root.get(i, i) for i in range(len(fps) + 30)] == [first[of[f]] for f in fps + fps[:30]]


def test_similar_texts_are_searched_by_fingerprint_and_then_exactly(spark, monkeypatch):
    rng = random.Random(26)
    part = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    texts = []
    for i in range(12):
        base = part(1000)
        # One word in a thousand leaves the fingerprint nearly as it is, one in fifty does not.
        texts += [base, [*base[:500], "x", *base[501:]], [f"y{i}x{at}" if at % 50 == 9 else w for at, w in enumerate(base)]]
    texts = [" ".join(t) for t in texts]
    prints = [s.majority(s.shingle_hashes(t, s.WORDS)) for t in texts]
    close = {(i, j) for i in range(36) for j in range(i + 1, 36) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4}
    assert 6 <= len(close) < 36
    searched, links_of, found = [], s.links_of, []
    monkeypatch.setattr(s, "links_of", lambda *a: searched.append(links_of(*a)) or searched[-1])
    confirmed = s.confirmed
    monkeypatch.setattr(s, "confirmed", lambda *a: found.append(confirmed(*a)) or found[-1])
    kept = s.keep_one_similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert sorted(r["doc_id"] for r in kept.collect()) == list(range(0, 36, 3))
    assert len(searched) == 1 and searched[0].count() >= 6
    assert found[0].count() >= 6 and len(found) > 1
