"""Lookups J3, J5, J6, J7 and the corpus-derived lookup tables.

Broadcast policy: only tables whose size is bounded by construction are hinted
(`stopwords` is a top-n, the genre map has 18 rows).  Tables that grow with the corpus
(lexicon, syllable table) are joined without a hint; AQE converts the join to a
broadcast only when the *measured* size is under `spark.sql.adaptive.autoBroadcastJoinThreshold`,
otherwise it stays a sort-merge join whose skewed partitions AQE splits.  Before such a join
stands a map of the words (`word_map`), which is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ALWAYS_ARGUMENTATIVE_LEVEL, ARGUMENTATIVE, EXAM_SESSIONS, GENRE_BY_EXAM
from ..functions.text import clean_lemma_lexicon, clean_lemma_stop, not_punct, syllables

STOPWORD_COUNT = 100


def lemma_counts(tokens: DataFrame) -> DataFrame:
    """(lemma, n): corpus count of every lemma of a word token.  Both lookup tables are
    re-keyed sums of this one aggregate, so the corpus is tokenised once for both."""
    return (tokens.where(F.col("word").isNotNull() & not_punct() & F.col("lemma").isNotNull())
            .groupBy("lemma").agg(F.count(F.lit(1)).alias("n")))


def build_stopwords(tokens: DataFrame | None = None, n: int = STOPWORD_COUNT,
                    counts: DataFrame | None = None) -> DataFrame:
    """Stopword table (Stoplemma): the n most frequent cleaned lemmas, ties by lemma.

    A top-n: Spark plans it as a per-partition top-n and one small merge."""
    counts = counts if counts is not None else lemma_counts(tokens)
    key = clean_lemma_stop("lemma")
    return (counts.groupBy(key.alias("Stoplemma")).agg(F.sum("n").alias("n"))
            .orderBy(F.col("n").desc(), F.col("Stoplemma")).limit(n)
            .select("Stoplemma"))


def build_lexicon(tokens: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Lexicon (lemma, abstractness, frequency) from corpus counts of lexicon keys.

    frequency = number of word tokens with the key; abstractness = 1 + ascii(first hex digit
    of md5(key)) mod 3 (a deterministic stand-in for a rated 1-3 scale)."""
    counts = counts if counts is not None else lemma_counts(tokens)
    key = clean_lemma_lexicon("lemma")
    counted = (counts.groupBy(key.alias("lemma")).agg(F.sum("n").cast("bigint").alias("frequency"))
               .where(F.col("lemma") != ""))
    return counted.select(
        "lemma",
        (F.lit(1) + F.pmod(F.ascii(F.substring(F.md5("lemma"), 1, 1)), F.lit(3)))
        .cast("double").alias("abstractness"),
        "frequency")


def stopword_hits(tokens: DataFrame, stopwords: DataFrame) -> DataFrame:
    """Add `is_stop` = cleaned lemma is a stopword (broadcast; the table is a top-n)."""
    stops = F.broadcast(stopwords.select(F.col("Stoplemma").alias("_stop_key"))
                        .distinct().withColumn("_stop_hit", F.lit(True)))
    joined = tokens.join(stops, clean_lemma_stop(tokens["lemma"]) == stops["_stop_key"], "left")
    return joined.withColumn("is_stop", F.coalesce("_stop_hit", F.lit(False))) \
                 .drop("_stop_key", "_stop_hit")


def lexicon_lookup(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Add abstractness/frequency of the cleaned lemma; unknown -> null."""
    lex = lexicon.select(F.col("lemma").alias("_lex_key"), "abstractness", "frequency")
    joined = tokens.join(lex, clean_lemma_lexicon(tokens["lemma"]) == lex["_lex_key"], "left")
    return joined.drop("_lex_key")


def syllable_lookup(tokens: DataFrame, syllable_table: DataFrame | None = None) -> DataFrame:
    """Syllables of each word from a (word, syllabified) table, else vowel groups."""
    if syllable_table is None:
        return tokens.withColumn("syllables", syllables("word"))
    syl = syllable_table.select(F.col("word").alias("_syl_word"), "syllabified")
    joined = tokens.join(syl, tokens["word"] == syl["_syl_word"], "left")
    return joined.withColumn(
        "syllables",
        F.coalesce(F.regexp_count("syllabified", F.lit("-")) + 1, syllables("word"))
    ).drop("_syl_word", "syllabified")


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small fixed table as a JVM-side inline literal (no Python worker, no RDD)."""
    structs = [F.struct(*[F.lit(v).alias(n) for v, n in zip(row, names)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


def genre_table(spark: SparkSession) -> DataFrame:
    return literal_table(spark, GENRE_BY_EXAM, ["g_level", "g_exam", "g_type"])


def genre_lookup(df: DataFrame, level: str = "prof_level", exam: str = "exam_time") -> DataFrame:
    """(level, exam session) -> text_type; C1 is always argumentative; no match -> null."""
    genres = F.broadcast(genre_table(df.sparkSession))
    joined = df.join(genres, (df[level] == genres["g_level"]) & (df[exam] == genres["g_exam"]), "left")
    return joined.withColumn(
        "text_type",
        F.when(F.col(level) == ALWAYS_ARGUMENTATIVE_LEVEL, F.lit(ARGUMENTATIVE))
        .otherwise(F.col("g_type"))).drop("g_level", "g_exam", "g_type")


def exam_from_source(source) -> "F.Column":
    """Exam session of a driver-table document: number in `source` mod 9 -> session list."""
    n = F.regexp_extract(F.col(source) if isinstance(source, str) else source, r"(\d+)", 1).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in EXAM_SESSIONS]), (F.pmod(n, F.lit(9)) + 1).cast("int"))


# ---- bounded maps of words ----------------------------------------------------------------------

#: Most 64-bit fields of a word map (8 MB), whatever the number of words.
MAP_FIELDS = 1 << 20


def _map_place(value: Column, fields: int) -> tuple[Column, Column]:
    """Field and two bits of a value, all from one hash."""
    h = F.xxhash64(value)
    bit = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, n).bitwiseAND(F.lit(63)).cast("int")) for n in (40, 48)]
    return F.pmod(h, F.lit(fields)).cast("int"), bit[0].bitwiseOR(bit[1])


def word_map(words: DataFrame, col: str) -> Callable[[Column], Column]:
    """A test that holds for every value of `col` and for few others, so that most rows without a partner never
    travel to a join.  It is a bit map of at most MAP_FIELDS fields: more words make it less choosy, not larger."""
    spark = words.sparkSession
    fields = min(MAP_FIELDS, 1 << max(words.count() // 4, 1).bit_length())
    field, bits = _map_place(F.col(col), fields)
    found = words.select(field.alias("field"), bits.alias("bits")).groupBy("field").agg(F.bit_or("bits").alias("bits")).toArrow()
    whole = np.zeros(fields, dtype=np.int64)
    whole[found["field"].to_numpy()] = found["bits"].to_numpy()
    one = spark.createDataFrame(pa.table({"fields": pa.array([whole], pa.list_(pa.int64()))}))

    def may_hold(value: Column) -> Column:
        at, want = _map_place(value, fields)
        return F.get(one.scalar(), at).bitwiseAND(want) == want
    return may_hold
