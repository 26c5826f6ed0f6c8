"""Incremental feature extraction with Structured Streaming.

New document files arriving in a folder are tagged and aggregated per micro-batch with
`foreachBatch`: documents are complete rows, so the per-document aggregate needs no
streaming state, and each epoch overwrites its own output partition (idempotent on retry,
so a lost executor or a restarted query does not duplicate rows).  Lookup tables are static
reference tables broadcast or joined per batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import level_from_id
from ..operators.features import feature_names, feature_table, prepare_tokens
from ..operators.lookups import exam_from_source, genre_lookup
from ..operators.tagging import tag_text


def features_of_batch(batch: DataFrame, lexicon: DataFrame | None = None,
                      stopwords: DataFrame | None = None) -> DataFrame:
    docs = batch.select("doc_id", "text", level_from_id("doc_id").alias("prof_level"),
                        exam_from_source("source").alias("exam_time"))
    toks = tag_text(docs, carry=("prof_level", "exam_time"))
    feats = feature_table(prepare_tokens(toks, lexicon=lexicon, stopwords=stopwords),
                          ["doc_id", "prof_level", "exam_time"])
    return genre_lookup(feats).select("doc_id", "prof_level", "exam_time", "text_type", *feature_names())


def start_feature_stream(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                         lexicon: DataFrame | None = None, stopwords: DataFrame | None = None,
                         available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the stream: parquet documents in `source_dir` -> feature rows under
    `sink_dir/epoch=<id>`.  Returns the StreamingQuery."""
    schema = spark.read.parquet(source_dir).schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        out = features_of_batch(batch, lexicon, stopwords).withColumn("epoch", F.lit(epoch_id))
        out.write.mode("overwrite").parquet(f"{sink_dir.rstrip('/')}/epoch={epoch_id}")

    w = stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
