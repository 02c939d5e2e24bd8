"""The registered query of each operator over its whole table, with its SQL twin where there is one."""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_folder
from . import bpe, chat, decontaminate, html, langid, linededup, repair, secrets, sharding, simhash, spelling, topk, warc
from .common import table, utf8_size


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of the conversations, read back from the formatted strings."""
    told = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    formatted = chat.format_turns(chat.canonical_turns(told.unionByName(tricky)))
    back = formatted.select(
        "conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss")).alias("trained"),
    )
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("long").alias("loss_chars"), F.sha2("trained", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '<(~*)s>', '<~\\1s>', 'g'), '<(~*)/s>', '<~\\1/s>', 'g'), "
    "'\\[(~*)INST\\]', '[~\\1INST]', 'g'), '\\[(~*)/INST\\]', '[~\\1/INST]', 'g')"
)

OP1_SQL = f"""
WITH told AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS trained,
    string_agg('<s>[INST] ' || {_ESCAPED.format('role')} || ' [/INST]' || chr(10) || {_ESCAPED.format('text')} || '</s>' || chr(10),
      '' ORDER BY turn, role, text) AS formatted
  FROM told GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(trained) AS loss_chars,
  sha256(trained) AS loss_sha256, length(formatted) AS formatted_chars
FROM whole
"""


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Which words of each document lie in windows of 10 benchmark words, and of which items."""
    found = decontaminate.find_windows(
        table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "benchmark"), keep=["doc_id"]
    )
    return found.select(
        "doc_id", "n_words", decontaminate.hit_words(F.col("spans")).alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
    )


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


OP2_SQL = f"""
WITH items AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i + 1 : i + least(10, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM items WHERE len(w) > 0)),
docs AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
places AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1 : i + n], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) AS lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, p.n, i, item_id FROM places AS p JOIN windows AS x ON p.n = x.n AND p.win = x.win),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in every document: spans of the fixed patterns and of random-looking tokens."""
    found = secrets.find_secrets(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"])
    base = F.col("base")
    return found.select(
        "doc_id", *[secrets.number_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secrets.written(base), 256).alias("base_sha256"), secrets.written(F.col("spans")).alias("spans"),
    )


def op4_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector with all other vectors."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    found = topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP4_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, row_number() OVER () AS r
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM whole AS q, whole AS c WHERE q.vec_id % 50 = 0 AND q.r <> c.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op5_html(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html.extract(table(spark, folder, "pages").select("page_id", "url", "html"), ["page_id", "url"])


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    found = simhash.groups(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("group").alias("component_id")
    )


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """The predicted language of every document, learned from rows that are not held out."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs.select("doc_id", "text"), langid.train(docs), ["doc_id"])
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document less the three-line windows that occur before it, and the removed lines."""
    done = linededup.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    span = F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))
    return done.select("doc_id", "text", "n_lines", "n_removed", F.array_join(span, ",").alias("removed"))


OP8_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS at_line
  FROM documents WHERE text IS NOT NULL),
counted AS (
  SELECT doc_id, at_line, trim(line) AS said, row_number() OVER (PARTITION BY doc_id ORDER BY at_line) - 1 AS c
  FROM lines WHERE trim(line) <> ''),
windows AS (
  SELECT a.doc_id, a.c, a.said || chr(10) || b.said || chr(10) || d.said AS win
  FROM counted AS a JOIN counted AS b ON a.doc_id = b.doc_id AND b.c = a.c + 1
  JOIN counted AS d ON a.doc_id = d.doc_id AND d.c = a.c + 2),
later AS (SELECT doc_id, c FROM (SELECT *, row_number() OVER (PARTITION BY win ORDER BY doc_id, c) AS nth FROM windows) WHERE nth > 1),
gone AS (
  SELECT DISTINCT k.doc_id, k.at_line FROM later AS l JOIN counted AS k ON k.doc_id = l.doc_id AND k.c BETWEEN l.c AND l.c + 2),
runs AS (
  SELECT doc_id, min(at_line) AS a, max(at_line) + 1 AS b
  FROM (SELECT *, at_line - row_number() OVER (PARTITION BY doc_id ORDER BY at_line) AS run FROM gone) GROUP BY doc_id, run),
spans AS (
  SELECT doc_id, string_agg(a || ':' || b, ',' ORDER BY a) AS removed, CAST(sum(b - a) AS BIGINT) AS n_removed FROM runs GROUP BY doc_id),
kept AS (
  SELECT doc_id, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY at_line) FILTER (WHERE g.at_line IS NULL) AS text
  FROM lines LEFT JOIN gone AS g USING (doc_id, at_line) GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed
FROM documents AS d LEFT JOIN kept AS k USING (doc_id) LEFT JOIN spans USING (doc_id)
"""


WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    """The place of a public vocabulary file, which the package that brings it knows."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the text decoded from them, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe.round_trip(docs, tokenizer_path(WORD_BPE), keep=["doc_id"])
    return done.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in 8 shards of equal row counts and equal mixture (law ``rows``)."""
    text = F.col("text")
    rows = table(spark, folder, "documents").select(
        "doc_id", "source", (utf8_size(text) + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return sharding.interleave(rows, "doc_id", "source", 8, "mixture").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )


# CRC-32 byte by byte: a table of 256 remainders, then one step per byte.
_CRC_STEP = "CASE WHEN ({0} & 1) = 1 THEN xor(({0} >> 1), 3988292384) ELSE ({0} >> 1) END"


def _crc_rounds() -> str:
    out = "[x::BIGINT for x in range(256)]"
    for _ in range(8):
        out = f"[{_CRC_STEP.format('x')} for x in {out}]"
    return out


OP10_SQL = f"""
WITH remainders AS (SELECT {_crc_rounds()} AS t),
read AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
codes AS (SELECT doc_id, source, text, hex(encode(text)) AS h FROM read),
sized AS (
  SELECT doc_id, source, strlen(text) + 1 AS size,
    xor(list_reduce([('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT for i in range(strlen(text))],
      lambda crc, b: xor(t[(xor(crc, b) & 255) + 1], (crc >> 8)), 4294967295), 4294967295) AS text_crc32
  FROM codes, remainders),
ranked AS (
  SELECT *, coalesce('=' || source, '') AS g, md5('mixture:' || doc_id) AS digest FROM sized),
spread AS (
  SELECT *, (row_number() OVER (PARTITION BY g ORDER BY digest, doc_id, source, size, text_crc32) * 2 - 1)::DOUBLE
    / (count(*) OVER (PARTITION BY g) * 2)::DOUBLE AS fraction FROM ranked),
placed AS (
  SELECT *, row_number() OVER (ORDER BY fraction, md5('mixture:' || g), digest, doc_id) - 1 AS place, count(*) OVER () AS n FROM spread),
cut AS (SELECT *, place * 8 // n AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, place - (7 + shard * n) // 8 AS slot,
  CAST(NULL AS INT) AS grown_shard, source
FROM cut
"""

def damaged(told: DataFrame) -> DataFrame:
    """Conversations with the faults that the CRC-32 of ``conv_id:turn`` deals out."""
    def or_space(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fate = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    text, role = or_space("text"), or_space("role")
    rows = told.withColumn("fate", fate).filter("fate <> 0").select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired turns of every damaged conversation."""
    told = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair.repair(damaged(told))
    every = told.select("conv_id").distinct()
    summary, digests = fixed.summary, fixed.digests()
    out = every.join(summary, every["conv_id"].eqNullSafe(summary["conv"]), "left").drop("conv")
    out = out.join(digests, out["conv_id"].eqNullSafe(digests["conv"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# A place of a conversation has, per state, the least (cost, audit) from there and the turns it leaves.
def _op11_sql() -> str:
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    added = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    keeps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

    def step(q: int, cost: str, edit: str, turns: str) -> str:
        return (
            f"{{'cost': s[{q + 1}].cost + {cost}, 'audit': '{edit}' || s[{q + 1}].audit, "
            f"'turns': {turns} || s[{q + 1}].turns}}"
        )

    def least(options: list[str]) -> str:
        return f"list_min([{', '.join(options)}])"

    over = []
    for q in range(4):
        options = [step(q, "2", "D", "[]::VARCHAR[]")]
        stays = "CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END"
        options.append(step(after[q], f"1 + {stays}", "R", f"['{added[q]}:' || text]"))
        for initial, moves in keeps.items():
            if q in moves:
                options.append(step(moves[q], f"{stays} + CASE WHEN left(role, 1) = '{initial}' THEN 0 ELSE 1000000000 END", "K", "[role || ':' || text]"))
        over.append(least(options))
    closed = [least([f"s[{q + 1}]", step(after[q], "5", "I", f"['{added[q]}:']")]) for q in range(4)]
    ends = "[{'cost': 0, 'audit': '', 'turns': []::VARCHAR[]}, {'cost': 10, 'audit': 'II', 'turns': ['user:', 'assistant:']}, {'cost': 5, 'audit': 'I', 'turns': ['assistant:']}, {'cost': 0, 'audit': '', 'turns': []::VARCHAR[]}]"
    return f"""
WITH RECURSIVE remainders AS (SELECT {_crc_rounds()} AS t),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS h
  FROM conversations),
dealt AS (
  SELECT conv_id, turn, role, text, xor(list_reduce([('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT for i in range(len(h) // 2)],
    lambda crc, b: xor(t[(xor(crc, b) & 255) + 1], (crc >> 8)), 4294967295), 4294967295) % 20 AS fate
  FROM named, remainders),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
  FROM dealt WHERE fate <> 0),
ordered AS (
  SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged),
judged AS (
  SELECT *, CASE WHEN said = '' THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM ordered),
found AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
  FROM judged GROUP BY conv_id),
walk AS (
  SELECT conv_id, n AS i, {ends} AS s FROM found
  UNION ALL
  SELECT conv_id, i, [{', '.join(closed)}] AS s FROM (
    SELECT conv_id, i, [{', '.join(closed)}] AS s FROM (
      SELECT w.conv_id, w.i - 1 AS i, [{', '.join(over)}] AS s
      FROM walk AS w JOIN judged AS j ON j.conv_id IS NOT DISTINCT FROM w.conv_id AND j.i = w.i WHERE w.i > 0))),
best AS (SELECT conv_id, s[1] AS b FROM walk WHERE i = 0)
SELECT k.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit,
  sha256(coalesce(array_to_string(b.turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS k
LEFT JOIN found AS f ON f.conv_id IS NOT DISTINCT FROM k.conv_id LEFT JOIN best AS e ON e.conv_id IS NOT DISTINCT FROM k.conv_id
"""


OP11_SQL = _op11_sql()


def misspelt(key: str, run: bytes) -> bytes:
    """The run (Latin-1), without one of its letters where 97 divides the CRC-32 of ``key:run``."""
    h = zlib.crc32(f"{key}:{run.decode('latin-1')}".encode())
    if h % 97:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The form and root of every frequent word of all documents."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return spelling.variants(spelling.word_counts(docs, edit=misspelt))


OP12_SQL = f"""
WITH RECURSIVE remainders AS (SELECT {_crc_rounds()} AS t),
said AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents),
counted AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS h FROM said GROUP BY doc_id, run),
marked AS (
  SELECT run, n, xor(list_reduce([('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT for i in range(len(h) // 2)],
    lambda crc, b: xor(t[(xor(crc, b) & 255) + 1], (crc >> 8)), 4294967295), 4294967295) AS crc
  FROM counted, remainders),
edited AS (
  SELECT CASE WHEN crc % 97 = 0 THEN run[1 : crc % length(run)] || run[crc % length(run) + 2 :] ELSE run END AS word, n FROM marked),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM edited WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
places AS (SELECT word, n, unnest(range(length(word))) AS i FROM words),
cuts AS (SELECT DISTINCT word, word[1 : i] || word[i + 2 :] AS shorter FROM places),
masks AS (SELECT word, word[1 : i] || '*' || word[i + 2 :] AS masked FROM places),
near AS (
  SELECT a.word AS a, b.word AS b FROM masks AS a JOIN masks AS b ON a.masked = b.masked AND a.word <> b.word
  UNION SELECT word, shorter FROM cuts WHERE shorter IN (SELECT word FROM words)
  UNION SELECT shorter, word FROM cuts WHERE shorter IN (SELECT word FROM words)),
best AS (
  SELECT a AS word, count(*) AS n_near, min({{'less': -n, 'form': b}}) AS best FROM near JOIN words AS w ON w.word = b GROUP BY a),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= 2 * n THEN best.form END AS form,
    CASE WHEN -best.less >= 2 * n THEN -best.less END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT s.word, f.form FROM steps AS s JOIN formed AS f ON f.word = s.at WHERE f.form IS NOT NULL),
roots AS (SELECT s.word, s.at AS root FROM steps AS s JOIN formed AS f ON f.word = s.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN roots USING (word)
"""

def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Every page as it reads back from archives that were written whole and normalised."""
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    shared = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    whole = warc.write_archives(warc.page_rows(pages), f"{shared}/whole")
    members = warc.normalise(whole, f"{shared}/members")
    back = warc.read_records(warc.index_entries(members), payloads=False)
    return back.select(
        F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"),
        F.col("refers_to").cast("long").alias("refers_to"),
    )


OP13_SQL = """
WITH told AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
ranked AS (
  SELECT *, strlen(html) AS size, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS nth,
    first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST, url NULLS LAST) AS original FROM told)
SELECT page_id, size AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN size >= 100 AND nth > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN size >= 100 AND nth > 1 THEN original END AS refers_to
FROM ranked
"""

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_decontamination": op2_decontamination,
    "op3_secrets": op3_secrets,
    "op4_topk": op4_topk,
    "op5_html": op5_html,
    "op6_simhash": op6_simhash,
    "op7_language_id": op7_language_id,
    "op8_line_dedup": op8_line_dedup,
    "op9_bpe": op9_bpe,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc": op13_warc,
}
SQL = {
    "op1_chat_formatting": OP1_SQL,
    "op2_decontamination": OP2_SQL,
    "op4_topk": OP4_SQL,
    "op8_line_dedup": OP8_SQL,
    "op10_sharding": OP10_SQL,
    "op11_conversation_repair": OP11_SQL,
    "op12_spelling_variants": OP12_SQL,
    "op13_warc": OP13_SQL,
}
