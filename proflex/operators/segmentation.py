"""Sentence split, chunking, delimiters and reassembly.

A sentence ends at a run of `.`, `!`, `?` that white space or the end of the text follows, so
"3.14" and "Nii..." stay whole.  The pieces tile the text: a piece is the white space before a
sentence and the sentence, and what is left behind the last one is the text's tail.  A document
without any sentence has one empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import WS

STRIP_PATTERN = rf"^[{WS}]+|(?<![{WS}])[{WS}]+$"
LEAD_PATTERN = rf"^[{WS}]*"
TAIL_PATTERN = rf"(?<![{WS}])[{WS}]+$"
CUT_PATTERN = rf"(?<=[.!?])(?=[{WS}])"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python-style strip(): remove leading and trailing white space of any kind."""
    return F.regexp_replace(_c(c), STRIP_PATTERN, "")


def _rows(docs: DataFrame, key: str, text: str, carry: tuple[str, ...]) -> DataFrame:
    """One row for each piece: sent_id, piece, sentence, tail (of the text)."""
    whole = F.coalesce(_c(text), F.lit(""))
    blank = whole.rlike(rf"^[{WS}]*$")
    # the search for a tail reads the whole text, so the last character is asked first
    ends = F.substring(whole, -1, 1).rlike(f"[{WS}]")
    body = F.when(blank, F.lit("")).when(ends, F.regexp_replace(whole, TAIL_PATTERN, "")).otherwise(whole)
    tail = F.when(blank, whole).when(ends, F.regexp_extract(whole, TAIL_PATTERN, 0)).otherwise(F.lit(""))
    # the tail is found below the generator: beside it, each piece would search the whole text again
    cut = docs.select(key, *carry, tail.alias("_tail"), F.split(body, CUT_PATTERN).alias("_pieces"))
    pieces = cut.select(key, *carry, "_tail", F.posexplode_outer("_pieces").alias("_p", "_piece"))
    return pieces.select(key, *carry, (F.col("_p") + 1).cast("int").alias("sent_id"), "_piece", "_tail",
                         F.regexp_replace("_piece", LEAD_PATTERN, "").alias("sentence"))


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, text) -> (key, *carry, sent_id, sentence); at least one row for each text."""
    return _rows(docs, key, text, carry).select(key, *carry, "sent_id", "sentence")


def delimiters(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T4 without offsets: (key, sent_id, sentence, delim, tail); `delim` is the white space
    before the sentence, `tail` that at the end of the text.  A projection, no shuffle."""
    return _rows(docs, key, text, ()).select(
        key, "sent_id", "sentence", F.regexp_extract("_piece", LEAD_PATTERN, 0).alias("delim"), F.col("_tail").alias("tail"))


def sentence_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T4: (key, sent_id, sentence, start); the starts are one running sum over a document."""
    rows = delimiters(docs, key, text)
    before = Window.partitionBy(key).orderBy("sent_id").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.length("delim") + F.length("sentence")).over(before), F.lit(0))
    return rows.select(key, "sent_id", "sentence", (passed + F.length("delim")).alias("start"))


def chunk(sentences: DataFrame, max_pos: int, col: str = "sentence") -> DataFrame:
    """Cut each sentence into pieces of at most `max_pos` characters (piece_no from 1)."""
    n = F.greatest(F.ceil(F.length(col) / F.lit(max_pos)), F.lit(1)).cast("int")
    exploded = sentences.withColumn("_k", F.explode(F.sequence(F.lit(1), n)))
    return exploded.select(
        *[c for c in sentences.columns if c != col],
        F.col("_k").alias("piece_no"),
        F.substring(F.col(col), (F.col("_k") - 1) * max_pos + 1, max_pos).alias(col))


def reassemble(pieces: DataFrame, keys: list[str], order: str, text: str, delim: str,
               tail: str | None = None) -> DataFrame:
    """T5: join ordered (delimiter, piece) rows back into one text per key; pieces are stripped.
    `tail`, the same in all rows of a key, follows the last piece."""
    item = F.struct(F.col(order).alias("o"),
                    F.concat(F.coalesce(F.col(delim), F.lit("")),
                             F.coalesce(strip_ws(text), F.lit(""))).alias("s"))
    end = F.coalesce(F.max(tail), F.lit("")) if tail else F.lit("")
    return (pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"), end.alias("_end"))
            .select(*keys, F.concat(F.array_join(F.transform("_items", lambda x: x["s"]), ""), "_end").alias("text")))
