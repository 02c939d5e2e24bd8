"""From raw documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet to the shared
checkpoint folder and read again as the next stage's documents.  All but the last
return the columns of documents.

* language: documents whose language is rejected go;
* lines: three-line windows that occurred before go from the texts, and documents of
  which nothing but white space is left by that;
* near copies: of each group of documents that share at least 0.8 of their shingles of
  five words, directly or by way of others, the one with the least id stays; SimHash
  fingerprints find most of a group and an exact search the rest;
* benchmark: documents that hold a benchmark window go;
* tokens: the packed token ids of every remaining text, and the SHA-256 of the text
  decoded from them.

Rows equal in doc_id and text are one document.  Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecare.llm import bpe, decontaminate, langid, linededup, simhash
from tablecare.llm.common import stored, table
from tablecare.llm.queries import WORD_BPE, tokenizer_path


def _columns(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = langid.predict(docs, langid.train(docs), docs.columns)
    return _columns(found.filter("accepted"), docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = linededup.drop_repeated_lines(docs)
    left = done.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return _columns(left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one_similar(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find_windows(docs, table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return _columns(found.filter(F.size("spans") == 0), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keep = [c for c in docs.columns if c not in ("text", "n_chars")]
    done = bpe.round_trip(docs, tokenizer_path(WORD_BPE), keep=keep)
    return done.withColumn("decoded_sha256", F.sha2(F.col("decoded").cast("binary"), 256)).drop("decoded")


STAGES = [
    ("language", keep_languages),
    ("lines", drop_lines),
    ("near copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("tokens", encode),
]

# Stages of learned languages, fingerprints and merges have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
