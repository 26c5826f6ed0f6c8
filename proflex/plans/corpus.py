"""Plans over the driver tables: documents -> tokens -> lookups -> feature table.

The documents of the driver tables carry no file name; their metadata is derived from
columns that exist: level = doc_id mod 4, exam session = number in `source` mod 9, and
text type by the genre lookup (J7) of (level, session).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import level_from_id
from ..operators.features import feature_names, feature_table, prepare_tokens
from ..operators.lookups import build_lexicon, build_stopwords, exam_from_source, genre_lookup, lemma_counts
from ..operators.tagging import drop_empty, tag_text
from ..session import table_path

#: Session setting: deal the documents into so many partitions first, for inputs stored as one
#: row group that no split size can cut.  Unset (the default) the reader's splits stay.
INPUT_PARTITIONS = "proflex.input.partitions"
META = ["prof_level", "exam_time"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text and the derived level / exam session (a projection, no shuffle)."""
    docs = read_table(spark, sf_dir, "documents")
    n = spark.conf.get(INPUT_PARTITIONS, None)
    if n:       # the caller asks for it, whatever the size
        docs = docs.repartition(int(n), "doc_id")
    return docs.select("doc_id", "text",
                       level_from_id("doc_id").alias("prof_level"),
                       exam_from_source("source").alias("exam_time"))


def tokens(spark: SparkSession, sf_dir: str, with_meta: bool = True, dealt: bool = False) -> DataFrame:
    """T1 over the driver documents; `dealt`: rows of a document id are in one partition."""
    carry = tuple(META) if with_meta else ()
    docs = documents(spark, sf_dir)
    return tag_text(deal(docs, "doc_id") if dealt else docs, carry=carry)


#: Bytes of stored documents in a partition of dealt ones: their tokens are sorted in memory.
DEALT_BYTES = 4 << 20


def deal(docs: DataFrame, key: str) -> DataFrame:
    """The documents dealt by their key into partitions of about `DEALT_BYTES`.  The texts move once; all that is
    grouped by the key above needs no further exchange, while tokens and their sets are many times as large."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // DEALT_BYTES))
    return docs.repartition(n, key)


def token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1 rows only, without the placeholders of pieces that hold no token."""
    return drop_empty(tokens(spark, sf_dir, with_meta=False))


def lookup_tables(toks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lexicon and stopwords from ONE per-lemma count of the corpus (the shared exchange is
    reused by both)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(toks.sparkSession)
    # one corpus pass: the distinct-lemma counts are written to the checkpoint folder and
    # both lookup tables read that small table
    counts = lemma_counts(toks).checkpoint(eager=True)
    return build_lexicon(counts=counts), build_stopwords(counts=counts)


def document_features(spark: SparkSession, sf_dir: str, names: list[str] | None = None,
                      with_lookups: bool = True) -> DataFrame:
    """A31 for the driver documents: doc_id, prof_level, exam_time, text_type + features."""
    toks = tokens(spark, sf_dir, dealt=True)
    if with_lookups:
        lexicon, stopwords = lookup_tables(tokens(spark, sf_dir))
        feats = feature_table(prepare_tokens(toks, stopwords=stopwords), ["doc_id", *META], names, lexicon=lexicon)
    else:
        feats = feature_table(prepare_tokens(toks), ["doc_id", *META], names)
    with_type = genre_lookup(feats)
    cols = ["doc_id", "prof_level", "exam_time", "text_type"] + (names or feature_names())
    return with_type.select(*cols)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Report form: doubles rounded to `digits` places (what the oracle compares)."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if f.dataType.typeName() in ("double", "float") else F.col(f.name)
                       for f in df.schema.fields])


# ---- error features (E*) ------------------------------------------------------------------

def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T2 over the driver documents: (doc_id, sent_id, sentence)."""
    from ..operators.segmentation import split_sentences
    return split_sentences(documents(spark, sf_dir).select("doc_id", "text"))


def form_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The count of every spelling, written once: one corpus pass for the dictionaries and the speller's candidates."""
    from ..operators.correction import word_form_counts
    from ..operators.tagging import tokenize
    from ..session import ensure_checkpoint_dir
    words = drop_empty(tokenize(documents(spark, sf_dir).select("doc_id", "text"))).select("word")
    ensure_checkpoint_dir(spark)
    return word_form_counts(words).checkpoint(eager=True)


def correction_dictionaries(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Correction list (J4) and truecase model (J8) derived from the corpus words."""
    from ..operators.correction import build_correction_list, build_truecase_model
    counts = counts if counts is not None else form_counts(spark, sf_dir)
    return build_correction_list(counts=counts), build_truecase_model(counts=counts)


def speller_model(spark: SparkSession, sf_dir: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The candidates of the corpus words, written once, and its n-gram counts.  These are several times as
    large as the corpus, so they are counted where they meet the n-grams that are asked for, and not stored."""
    from ..operators.speller import candidates, ngram_counts, word_counts
    counts = counts if counts is not None else form_counts(spark, sf_dir)
    return (candidates(word_counts(counts=counts).checkpoint(eager=True)).checkpoint(eager=True),
            ngram_counts(sentences(spark, sf_dir), hashed=True))


def sentence_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.errors import sentence_error_stats
    counts = form_counts(spark, sf_dir)
    cl, tm = correction_dictionaries(spark, sf_dir, counts)
    return sentence_error_stats(sentences(spark, sf_dir), "doc_id", cl, tm, speller_model(spark, sf_dir, counts))


def document_error_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E11 for the driver documents: doc_id + nine error ratios."""
    from ..operators.errors import error_feature_table
    return error_feature_table(sentence_stats(spark, sf_dir), "doc_id")


def merged_features(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> DataFrame:
    """Feature table inner-joined with the error features on the document key.

    `syllable_count` is published as `syll_count`, the name the classifiers read."""
    feats = document_features(spark, sf_dir, names).withColumnRenamed("syllable_count", "syll_count")
    return feats.join(document_error_features(spark, sf_dir), "doc_id", "inner")
