"""Operator 2: document fingerprints by Order MinHash.

The items of a text are its k-mers (k code points), each with the number of its occurrence, so
a repeated k-mer counts as often as it stands there.  Each slot of the fingerprint orders all
items by its own hash, takes the TUPLE smallest, puts them back into text order and hashes the
tuple of their k-mers.  Two texts agree in a slot when the same k-mers were chosen *and* stand
in the same order, so the share of equal slots falls with edits and with moved passages.

A text shorter than k is one k-mer; a text with one item gives tuples that repeat it; the empty
text has a fingerprint of zeros.  Equal texts have equal fingerprints.  A slot keeps 16 bits, so
unrelated slots agree once in 65,536.

`fingerprint_edits` compares each document with its edited text and with the next document in
descending order of the id (equal ids: order of a text hash; null ids come last; after the last
comes the first).  Texts are dealt out once, by ranges of the id; a task pairs neighbours as it
reads its sorted range, and only the first and last row of each range travel again.

Edge cases: null texts count as empty; repeated rows are neighbours; other columns are not read;
a table of one row is its own next document; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, materialize

K = 8               # code points of a k-mer, a power of two
SLOTS = 64
TUPLE = 2
CHUNK = 1 << 13     # items hashed at a time, so that a block of slots x items fits a cache
POSITION_BITS = 20  # texts of up to 2**20 items sort by packed keys

ODD = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
BITS = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_2)
    return x ^ (x >> np.uint64(31))


def mix_int(x: int) -> int:
    x = (x ^ (x >> 30)) * MIX_1 & BITS
    x = (x ^ (x >> 27)) * MIX_2 & BITS
    return x ^ (x >> 31)


#: One odd multiplier for each slot.
SEEDS = [mix_int((i + 1) * ODD & BITS) >> 32 | 1 for i in range(SLOTS)]
_SEEDS = np.array(SEEDS, np.uint32)[:, None]
_SLOT = np.arange(1, SLOTS + 1, dtype=np.uint64)


def kmers(text: str, k: int = K) -> np.ndarray:
    """A 64-bit hash of each k-mer, in text order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    if not len(codes):
        return codes
    step = 1
    while step < k and len(codes) > step:
        codes = codes[:-step] * np.uint64(mix_int(ODD * step & BITS) | 1) + mix(codes[step:])
        step *= 2
    return mix(codes if step >= k else codes[:1] + np.uint64(step))


def items(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash of each (k-mer, occurrence number), and the item's place in the text."""
    n = len(hashes)
    if n <= 1 << POSITION_BITS:
        low = np.uint64((1 << POSITION_BITS) - 1)
        keys = np.sort((hashes & ~low) | np.arange(n, dtype=np.uint64))
        places = (keys & low).astype(np.int64)
    else:
        places = np.argsort(hashes & ~np.uint64((1 << POSITION_BITS) - 1), kind="stable")
    ordered = hashes[places]
    index = np.arange(n)
    begins = np.ones(n, bool)
    begins[1:] = (ordered[1:] ^ ordered[:-1]) >> np.uint64(POSITION_BITS) != 0
    occurrence = (index - np.maximum.accumulate(np.where(begins, index, 0))).astype(np.uint64)
    repeated = occurrence > 0
    if repeated.any():
        ordered = ordered.copy()
        ordered[repeated] = mix(ordered[repeated] + occurrence[repeated] * np.uint64(ODD))
    return (ordered >> np.uint64(32)).astype(np.uint32), places


def fingerprint(text: str) -> np.ndarray:
    """SLOTS values of 16 bits."""
    hashes = kmers(text)
    if not len(hashes):
        return np.zeros(SLOTS, np.uint16)
    drawn, places = items(hashes)
    n, rows = len(drawn), np.arange(SLOTS)
    values, chosen = [], []
    for start in range(0, n, CHUNK):
        block = drawn[start:start + CHUNK] * _SEEDS
        for _ in range(min(TUPLE, block.shape[1])):
            at = block.argmin(1)
            values.append(block[rows, at])
            chosen.append(at + start)
            block[rows, at] = 0xFFFFFFFF
    values, chosen = np.array(values).T, np.array(chosen).T
    order = np.lexsort((chosen, values), axis=1)[:, :TUPLE]
    found = np.sort(places[np.take_along_axis(chosen, order, 1)], axis=1)
    total = _SLOT * np.uint64(ODD)
    for j in range(TUPLE):
        total = mix(total + hashes[found[:, min(j, found.shape[1] - 1)]])
    return (total >> np.uint64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, 0 to 1."""
    return float(np.count_nonzero(a == b)) / SLOTS


def printed(slots: np.ndarray) -> str:
    return slots.astype(">u2").tobytes().hex()


def edited(text: str, following: str) -> str:
    """The last half of the text (rounded down) replaced by the start of the following one."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compared(text: str, own: np.ndarray, following: str, following_own: np.ndarray) -> tuple:
    changed = edited(text, following)
    other = fingerprint(changed)
    return (len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), printed(own), printed(other),
            likeness(own, other), likeness(own, following_own))


def fingerprint_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of every text; a projection of the rows."""
    source = id_and_text(df, id_col, text_col)
    id_type = source.schema["doc_id"].dataType.simpleString()

    def make():
        return lambda doc_id, text: [(doc_id, len(text or ""), printed(fingerprint(text or "")))]
    return map_batches(source, make, f"doc_id {id_type}, n_chars bigint, fingerprint string")


def fingerprint_edits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    source = id_and_text(df, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    order = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = source.repartitionByRange(ranges, F.col("doc_id").desc_nulls_last()).sortWithinPartitions(*order)
    id_type = source.schema["doc_id"].dataType.simpleString()
    result = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
              "near_edited double, near_next double")
    # kind 0: a finished row; 1: the first and last row of a range, whose neighbour is elsewhere
    fields = f"kind int, doc_id {id_type}, {result}, first_id {id_type}, first_text string, last_text string"
    schema = T.StructType.fromDDL(fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        first = last = None
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                row = (doc_id.as_py(), text.as_py())
                row += (fingerprint(row[1]),)
                if last is None:
                    first = row
                else:
                    out.append((0, last[0], *compared(last[1], last[2], row[1], row[2]), None, None, None))
                last = row
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), arrow)], schema=arrow)
        if last is not None:
            ends = (1, last[0], *[None] * 6, first[0], first[1], last[1])
            yield pa.RecordBatch.from_arrays([pa.array([c], t.type) for c, t in zip(ends, arrow)], schema=arrow)

    rows = materialize(ranged.mapInArrow(run, schema))
    ends = rows.where("kind = 1")
    # One row of two ids for each range: which range follows which.
    by_id = Window.orderBy(F.col("first_id").desc_nulls_last())
    follows = (ends.select("first_id").withColumn("n", F.row_number().over(by_id))
               .withColumn("next_id", F.lead("first_id").over(by_id))
               .withColumn("last", F.lead("n").over(by_id).isNull())
               .withColumn("next_id", F.when(F.col("last"), F.first("first_id").over(by_id)).otherwise(F.col("next_id")))
               .select("first_id", "next_id"))
    heads = ends.select(F.col("first_id").alias("head_id"), F.col("first_text").alias("next_text"))
    joined = (ends.select("doc_id", "first_id", "last_text").alias("e")
              .join(follows.alias("f"), F.expr("e.first_id <=> f.first_id"))
              .join(heads.alias("h"), F.expr("f.next_id <=> h.head_id"))
              .select("e.doc_id", F.col("e.last_text").alias("text"), "h.next_text"))

    def make():
        return lambda doc_id, text, after: [(doc_id, *compared(text, fingerprint(text), after, fingerprint(after)))]

    finished = rows.where("kind = 0").select("doc_id", *[p.split()[0] for p in result.split(", ")])
    return finished.unionByName(map_batches(joined, make, f"doc_id {id_type}, {result}"))
