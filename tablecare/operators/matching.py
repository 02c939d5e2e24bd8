"""Phrases against cell values: word matches, near misses, nearest values.

Phrases are a short list given by the caller, so their table is as small as the
call that made it; values are distinct per column and meet a phrase only through
a shared block key, never all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import words
from ..functions.text import fold_key
from .cells import cells

VOCABULARY_SHARE = 0.6


def value_index(df: DataFrame, columns: list[str]) -> DataFrame:
    """One spelling per folded value and column, with its words."""
    filled = cells(df, columns).filter(F.col("value").isNotNull())
    spelled = filled.select("column", "value").distinct().withColumn("key", fold_key(F.col("value")))
    return spelled.filter("key <> ''").groupBy("column", "key").agg(F.min("value").alias("value")).select(
        "column", "value", words.tokens(F.col("value")).alias("v")
    )


def phrase_table(spark: SparkSession, phrases: list[str]) -> DataFrame:
    table = spark.createDataFrame([(p,) for p in dict.fromkeys(phrases)], "phrase string")
    return table.withColumn("q", words.tokens(F.col("phrase"))).filter(F.size("q") > 0)


def _best(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """The first ``n`` per phrase, or all of them in order."""
    if n is None:
        return df.orderBy("phrase", *order)
    window = Window.partitionBy("phrase").orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(window)).filter(F.col("__rn") <= n).drop("__rn")


def value_candidates(index: DataFrame, phrases: list[str], n: int | None = None) -> DataFrame:
    """Values a phrase could mean, scored 3, 2, 1 or 0.5, best first.

    Every word of a phrase must be found, so values are looked up by its first
    word: whole, as a prefix, or in folded form.
    """
    spark = index.sparkSession
    asked = phrase_table(spark, phrases).withColumn("qf", words.fold_words(F.col("q")))
    lengths = sorted({len(w) for p in phrases for w in _first_word(p)})
    block = F.array_distinct(F.array(F.col("q")[0], F.concat(F.lit("~"), F.col("qf")[0])))
    asked = asked.withColumn("block", F.explode(block))
    prefixes = F.flatten(F.transform(
        "v", lambda w: F.transform(F.array(*[F.lit(k) for k in lengths]), lambda k: F.substring(w, F.lit(1), k))
    ))
    by_form = F.transform("vf", lambda w: F.concat(F.lit("~"), w))
    values = index.withColumn("vf", words.fold_words(F.col("v"))).withColumn(
        "block", F.explode(F.array_distinct(F.concat(prefixes, by_form)))
    )
    met = values.join(F.broadcast(asked), "block").select("phrase", "column", "value", "q", "qf", "v", "vf").distinct()
    score = words.match_score(F.col("q"), F.col("v"), F.col("qf"), F.col("vf"))
    scored = met.select("phrase", "column", "value", score.alias("score")).filter("score IS NOT NULL")
    order = [F.desc("score"), F.length("value").asc(), F.asc("value"), F.asc("column")]
    return _best(scored.withColumn("exact", F.col("score") == 3), order, n)


def _first_word(phrase: str) -> list[str]:
    found = "".join(ch if ch.isascii() and ch.isalnum() else " " for ch in phrase.lower()).split()
    return found[:1]


def typo_candidates(index: DataFrame, phrases: list[str], n: int | None = None) -> DataFrame:
    """Values with a word one or two edits from a one-word phrase, closest first.

    Every distinct word is compared once, and only where its length differs by no
    more than the edits allowed and it holds one of the phrase's pieces: of one
    piece more than the edits allowed, one stays whole.
    """
    folded = words.fold_spelling(F.col("q")[0])
    asked = phrase_table(index.sparkSession, phrases).filter(F.size("q") == 1).select(
        "phrase", folded.alias("a"), words.typo_budget(F.length(F.col("q")[0])).alias("budget"),
    ).filter("budget > 0")
    length, size = F.length("a"), F.floor(F.length("a") / (F.col("budget") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("budget")), lambda i: F.col("a").substr(i * size + 1, size))
    asked = asked.select(
        "phrase", "a", "budget", F.when(size > 0, pieces).alias("pieces"),
        F.explode(F.sequence(length - F.col("budget"), length + F.col("budget"))).alias("len"),
    )
    spelled = index.select("column", "value", F.explode(F.array_distinct("v")).alias("w")).select(
        "column", "value", words.fold_spelling(F.col("w")).alias("b")
    )
    known = spelled.select("b").distinct().withColumn("len", F.length("b"))
    whole = F.exists("pieces", lambda p: F.col("b").contains(p)) | F.col("pieces").isNull()
    near = known.join(F.broadcast(asked), "len").filter(whole).select(
        "phrase", "b", "budget", words.edit_distance(F.col("a"), F.col("b"), 2).alias("distance")
    ).filter(F.col("distance") <= F.col("budget"))
    best = spelled.join(near, "b").groupBy("phrase", "column", "value").agg(F.min("distance").alias("distance"))
    return _best(best, [F.asc("distance"), F.length("value").asc(), F.asc("value"), F.asc("column")], n)


def nearest_values(index: DataFrame, columns: list[str], phrases: list[str], n: int = 3) -> DataFrame:
    """The ``n`` values or column names that share most words with a phrase.

    Words agree when one starts with the other.  Every distinct word is compared
    once, and only with phrase words of the same first two letters, or of the same
    first letter where one of them is a single letter.
    """
    spark = index.sparkSession
    names = spark.createDataFrame([(c,) for c in columns], "value string").select(
        F.lit("column").alias("kind"), F.col("value").alias("column"), "value", words.tokens(F.col("value")).alias("v")
    )
    targets = index.select(F.lit("value").alias("kind"), "column", "value", "v").unionByName(names)
    words_of = targets.select("kind", "column", "value", F.explode(F.array_distinct("v")).alias("w"))
    start = lambda c, k: F.concat(F.lit(str(k)), F.substring(c, 1, k))
    asked = phrase_table(spark, phrases).select("phrase", F.posexplode("q").alias("at", "a"))
    short_too = F.array(start("a", 2), F.concat(F.lit("2"), F.substring("a", 1, 1)))
    asked = asked.withColumn("block", F.explode(F.when(F.length("a") > 1, short_too).otherwise(F.array(start("a", 1)))))
    known = words_of.select("w").distinct().withColumn("block", F.explode(F.array(start("w", 1), start("w", 2))))
    agree = F.col("w").startswith(F.col("a")) | F.col("a").startswith(F.col("w"))
    met = known.join(F.broadcast(asked), "block").filter(agree).select("phrase", "at", "w").distinct()
    hits = words_of.join(met, "w").groupBy("phrase", "kind", "column", "value").agg(
        F.count_distinct("at").alias("overlap")
    )
    order = [F.desc("overlap"), F.length("value").asc(), F.asc("kind"), F.asc("value"), F.asc("column")]
    return _best(hits, order, n)


def columns_by_vocabulary(index: DataFrame, vocabulary: DataFrame, share: float = VOCABULARY_SHARE) -> DataFrame:
    """Columns whose distinct values mostly hold a vocabulary word, most matches first.

    ``vocabulary`` has one column ``word``.
    """
    known = vocabulary.select(words.fold_word(F.lower("word")).alias("w")).distinct()
    tokens = index.select("column", "value", F.explode_outer(words.fold_words(F.col("v"))).alias("w"))
    held = tokens.join(known.withColumn("hit", F.lit(1)), "w", "left").groupBy("column", "value").agg(
        F.max("hit").alias("hit")
    )
    per_column = held.groupBy("column").agg(F.count("hit").alias("matched"), F.count(F.lit(1)).alias("total"))
    return per_column.filter(F.col("matched") / F.col("total") >= share).orderBy(F.desc("matched"), F.length("column"))
