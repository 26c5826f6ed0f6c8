"""Sources and sinks.

Readers use explicit schemas (CSV features without a given schema are inferred) and Spark's own file sources, so they split
and scale like any other scan.  Text-like formats keep the reference conventions (`None` as
the null token, quote-free TSV for tagged tokens) but the default sink is Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.correction import keep_last
from ..operators.segmentation import strip_ws

TOKENS_SCHEMA = T.StructType([
    T.StructField("Index", T.IntegerType()), T.StructField("Word", T.StringType()),
    T.StructField("Lemma", T.StringType()), T.StructField("Upos", T.StringType()),
    T.StructField("Xpos", T.StringType()), T.StructField("Feats", T.StringType()),
])

LEXICON_JSON_SCHEMA = T.StructType([
    T.StructField("wordAnalysis", T.ArrayType(T.StructType([
        T.StructField("lemmas", T.ArrayType(T.StructType([
            T.StructField("lemma", T.StringType()),
            T.StructField("abstractness", T.DoubleType()),
            T.StructField("frequency", T.LongType()),
        ]))),
    ]))),
])


def scan_texts(spark: SparkSession, paths: list[str] | str, glob: str = "*.txt") -> DataFrame:
    """One record per file: (file_name, dir, text); CRLF folded to LF, right-stripped."""
    df = spark.read.text(paths if isinstance(paths, list) else [paths], wholetext=True,
                         pathGlobFilter=glob)
    path = F.col("_metadata.file_path")
    return df.select(
        F.regexp_extract(path, r"([^/]+)$", 1).alias("file_name"),
        F.regexp_extract(path, r"^(?:file:)?(.*)/[^/]+$", 1).alias("dir"),
        F.regexp_replace(F.regexp_replace("value", "\r\n?", "\n"), r"\s+$", "").alias("text"))


def write_tagged(tokens: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet") -> None:
    """The token table with its keys (every column beside the six of a token) in front.

    Parquet by default; `tsv` writes a header (keys, Index, Word, Lemma, Upos, Xpos, Feats) and nulls as
    `None`, in which a token `None` cannot be told from a null."""
    named = {name.lower() if name != "Index" else "idx": name for name in TOKENS_SCHEMA.names}
    keys = [c for c in tokens.columns if c not in named]
    if fmt == "parquet":
        w = tokens.select(*keys, *named).write.mode("overwrite")
        (w.partitionBy(partition_by) if partition_by else w).parquet(path)
        return
    w = (tokens.select(*keys, *[F.col(c).alias(name) for c, name in named.items()]).write.mode("overwrite")
         .option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "None"))
    (w.partitionBy(partition_by) if partition_by else w).csv(path)


def read_tagged(spark: SparkSession, path: str, fmt: str = "parquet", keys: str = "", file_key: str = "") -> DataFrame:
    """S3: tagged files -> token table with its keys.

    For `tsv` the key columns in front are named by the DDL `keys`; `file_key` names a column for the
    file's name, which is the key where each text has a file of its own.  Quote-free (a lone `"` token
    stays a token)."""
    if fmt == "parquet":
        return spark.read.parquet(path)
    front = T.StructType.fromDDL(keys) if keys else T.StructType()
    df = (spark.read.option("sep", "\t").option("header", True).option("quote", "")
          .option("nullValue", "None").schema(T.StructType(front.fields + TOKENS_SCHEMA.fields)).csv(path))
    of_file = [F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias(file_key)] if file_key else []
    return df.select(*of_file, *front.names, F.col("Index").alias("idx"), F.col("Word").alias("word"),
                     F.col("Lemma").alias("lemma"), F.col("Upos").alias("upos"),
                     F.col("Xpos").alias("xpos"), F.col("Feats").alias("feats"))


def read_labels(spark: SparkSession, path: str) -> list[str]:
    """Newline list of column names that fixes the column order (a small file)."""
    return [r["value"] for r in spark.read.text(path).collect() if r["value"]]


def write_features(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Feature, error-feature, split and merged tables (Parquet by default; CSV with
    header and `None` for nulls when asked)."""
    if fmt == "csv":
        df.write.mode("overwrite").option("header", True).option("nullValue", "None").csv(path)
    else:
        df.write.mode("overwrite").parquet(path)


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None,
                  fmt: str = "parquet") -> DataFrame:
    """Feature table with header; explicit schema for CSV."""
    if fmt == "csv":
        r = spark.read.option("header", True).option("nullValue", "None")
        return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)
    return spark.read.parquet(path)


def read_stopwords(spark: SparkSession, path: str) -> DataFrame:
    """One-column CSV (header `Stoplemma`) -> distinct stopword table."""
    return spark.read.option("header", True).csv(path).select("Stoplemma").distinct()


def scan_lines(spark: SparkSession, path: list[str] | str) -> DataFrame:
    """(file, line, value) of text files; `line` orders the lines of a file: the place of the block
    that was read, and the row's number in its task, where the rows of a block follow each other."""
    lines = spark.read.text(path if isinstance(path, list) else [path])
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("file"), at.alias("line"), "value")


def parse_correction_lines(lines: DataFrame) -> DataFrame:
    """(wrong, right) from (file, line, value): the first line of each file is its header, of the others
    field 0 is corrected to the stripped field 1; lines of one field are none; of equal keys the
    last wins, in order of file and line."""
    heads = lines.groupBy(F.col("file").alias("_file")).agg(F.min("line").alias("_head"))
    body = lines.join(heads, (F.col("file") == F.col("_file")) & (F.col("line") == F.col("_head")), "left_anti")
    parts = body.select(F.split("value", ";").alias("p"), F.struct("file", "line").alias("_line"))
    rows = parts.where(F.size("p") >= 2).select(
        F.col("p")[0].alias("wrong"), strip_ws(F.col("p")[1]).alias("right"), "_line")
    return keep_last(rows, "wrong", "_line").drop("_line")


def parse_truecase_lines(lines: DataFrame) -> DataFrame:
    """(key, word, freq) from (file, line, value): `word<TAB>freq`; a line without a frequency gets 5;
    key = lower(word); of equal keys the last wins, in order of file and line."""
    stripped = strip_ws(F.col("value"))
    parts = lines.select(F.split(stripped, "\t").alias("p"), stripped.alias("s"), F.struct("file", "line").alias("_line"))
    two = F.size("p") == 2
    rows = parts.select(
        F.when(two, F.col("p")[0]).otherwise(F.col("s")).alias("word"),
        F.when(two, F.coalesce(F.col("p")[1].try_cast("int"), F.lit(5))).otherwise(F.lit(5)).alias("freq"),
        "_line")
    keyed = rows.withColumn("key", F.lower("word"))
    return keep_last(keyed, "key", "_line").select("key", "word", "freq")


def read_correction_list(spark: SparkSession, path: list[str] | str) -> DataFrame:
    """S10 from files."""
    return parse_correction_lines(scan_lines(spark, path))


def read_truecase_list(spark: SparkSession, path: list[str] | str) -> DataFrame:
    """S11 from files."""
    return parse_truecase_lines(scan_lines(spark, path))


def encode_response(df: DataFrame, col: str = "response", out: str = "json") -> DataFrame:
    """Nested response struct -> JSON text; null fields are written as null."""
    return df.withColumn(out, F.to_json(F.col(col), {"ignoreNullFields": "false"}))


def write_report(df: DataFrame, path: str) -> None:
    """Append evaluation results (long form) to a Parquet results table."""
    df.withColumn("written_at", F.current_timestamp()).write.mode("append").parquet(path)


def parse_lexicon_json(answers: DataFrame, key: str = "file_name", col: str = "json") -> tuple[DataFrame, DataFrame]:
    """Stored lexicon answers -> (key, position, lemma, abstractness, frequency) using only
    the first analysis of each word; undecodable answers go to a side table of keys."""
    parsed = answers.select(key, F.from_json(col, LEXICON_JSON_SCHEMA).alias("j"), col)
    bad = parsed.where(F.col("j").isNull() | F.col("j.wordAnalysis").isNull()).select(key)
    good = parsed.where(F.col("j.wordAnalysis").isNotNull())
    rows = good.select(key, F.posexplode("j.wordAnalysis").alias("position", "w")) \
               .select(key, "position", F.element_at("w.lemmas", 1).alias("l")) \
               .select(key, "position", F.col("l.lemma").alias("lemma"),
                       F.col("l.abstractness").alias("abstractness"), F.col("l.frequency").alias("frequency"))
    return rows, bad
