"""T4 for pieces of any splitter, T9 and P8: whole-text correction requests.

T4.  The delimiters of a text are what stands between its pieces, each searched from the end of the
one before; when a piece is not found they are nothing, single spaces and nothing.  The search of a
text is one walk over it, so it runs as a row function on Arrow batches; the rows stay where they are.

T9.  A request is a text of at most `max_chars` characters (P8).  The plan has two outputs: responses, with
corrections at places of the full text, and the rejected requests.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..constants import MAX_REQUEST_CHARS
from .correction import add_spans, dictionary_correct
from .segmentation import CUT_PATTERN, LEAD_PATTERN, delimiters, strip_ws

BATCH_PIECES = 4096


def delimiters_of(text: str, pieces: list[str]) -> list[str]:
    """What stands before each piece, and at last behind them all."""
    at, found = 0, []
    for piece in pieces:
        start = text.find(piece, at)
        if start < 0:
            return ["", *[" "] * (len(pieces) - 1), ""]
        found.append(text[at:start])
        at = start + len(piece)
    return [*found, text[at:]]


def piece_array(text: Column, max_pos: int) -> Column:
    """T2 + T3 as an array: the sentences of a text, cut into pieces of at most `max_pos`
    characters; a text without any sentence has one empty piece."""
    sentences = F.transform(F.split(F.coalesce(text, F.lit("")), CUT_PATTERN), strip_ws)
    cut = F.flatten(F.transform(sentences, lambda s: F.transform(
        F.sequence(F.lit(1), F.greatest(F.ceil(F.length(s) / max_pos), F.lit(1))),
        lambda k: F.substring(s, ((k - 1) * max_pos + 1).cast("int"), F.lit(max_pos)))))
    pieces = F.filter(cut, lambda p: p != "")
    return F.when(F.size(pieces) == 0, F.array(F.lit(""))).otherwise(pieces)


def piece_delimiters(docs: DataFrame, pieces: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """T4: (key, piece_no, piece, delim, tail) for an array of pieces of each text; `delim` stands before
    the piece, `tail` behind the last one."""
    key_type = docs.schema[key].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{key} {key_type}, piece_no int, piece string, delim string, tail string")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for k, whole, parts in zip(*(c.to_pylist() for c in batch.columns)):
                *found, tail = delimiters_of(whole, parts)
                for n, (piece, delim) in enumerate(zip(parts, found), 1):
                    out.append((k, n, piece, delim, tail))
                    if len(out) >= BATCH_PIECES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)

    return docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("whole"), pieces.alias("pieces")).mapInArrow(run, schema)


def length_gate(requests: DataFrame, text: str = "text", max_chars: int = MAX_REQUEST_CHARS) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); a null text is an empty one and accepted."""
    chars = F.length(F.coalesce(F.col(text), F.lit("")))
    return requests.where(chars <= max_chars), requests.where(chars > max_chars)


def process_requests(requests: DataFrame, key: str = "doc_id", text: str = "text", max_chars: int = MAX_REQUEST_CHARS,
                     **correctors) -> tuple[DataFrame, DataFrame]:
    """(responses, rejected).  Responses: key, corrections (start, end, value, replacement, in order, at
    places of the text), original_text, corrected_text, status_code and status; rejected: key, chars,
    status_code and status.  `correctors` are those of `dictionary_correct`, for the spelling column.

    One exchange by sentence key brings the changes back, another gathers a text's sentences: a text
    that was let through is bounded by `max_chars`."""
    accepted, rejected = length_gate(requests, text, max_chars)
    rows = delimiters(accepted, key, text)
    fixed = dictionary_correct(rows.select(key, "sent_id", "sentence"), [key, "sent_id"], "sentence", **correctors)
    spans = add_spans(fixed, "sentence", "spell_pieces", "spans").select(key, "sent_id", "spell_target", "spans")
    joined = rows.join(spans, [key, "sent_id"])
    item = F.struct("sent_id", "delim", "sentence", "spell_target", "spans", "tail")
    gathered = joined.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    # the place of each sentence: a fold over the sentences of one bounded text
    places = F.aggregate("_s", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")), lambda a, x: F.struct(
        (a["at"] + F.length(x["delim"]) + F.length(x["sentence"])).alias("at"),
        F.array_append(a["starts"], a["at"] + F.length(x["delim"])).alias("starts")), lambda a: a["starts"])
    corrections = F.flatten(F.transform("_s", lambda x, i: F.transform(x["spans"], lambda s: F.struct(
        (s["start"] + F.get("_starts", i)).alias("start"), (s["end"] + F.get("_starts", i)).alias("end"),
        s["value"].alias("value"), s["replacement"].alias("replacement")))))
    corrected = F.concat(F.array_join(F.transform("_s", lambda x: F.concat(x["delim"], strip_ws(x["spell_target"]))), ""),
                         F.get("_s", F.lit(0))["tail"])
    original = F.concat(F.array_join(F.transform("_s", lambda x: F.concat(x["delim"], x["sentence"])), ""), F.get("_s", F.lit(0))["tail"])
    responses = gathered.withColumn("_starts", places).select(
        key, corrections.alias("corrections"), original.alias("original_text"), corrected.alias("corrected_text"),
        F.lit(200).alias("status_code"), F.lit("OK").alias("status"))
    refused = rejected.select(key, F.length(text).alias("chars"), F.lit(422).alias("status_code"),
                              F.lit(f"text is longer than {max_chars} characters").alias("status"))
    return responses, refused
