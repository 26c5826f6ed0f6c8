"""Operator 5: removal of repeated byte strings with suffix arrays built by linear grouping.

Every byte covered by a SPAN-byte string that also starts anywhere else goes.

1. Anchors.  In each SPAN-byte window of a text the leftmost smallest hash of its GRAM-byte
   strings is the window's anchor, so equal windows have equal anchors at the same place.  Each
   anchor serves a run of windows; the bytes of that run are its context.
2. Counts.  Contexts are counted by (anchor hash, context hash), summed within each task first.
   A context that stands in two places is repeated as a whole.  An anchor with one place repeats
   nothing.  What is left are anchors with several different contexts.
3. Suffix arrays.  The different contexts of an anchor are joined and their suffixes sorted; a
   window is repeated when its neighbour in the suffix array begins with the same SPAN bytes.
   Contexts are first cut to what any other context of the anchor shares with them, and equal
   ones are merged.
4. The runs of repeated windows go back to the documents, which are cut and hashed.

The suffix array is built by grouping (`suffix_array`): suffixes are kept in groups by a prefix,
in order; groups are processed from the highest down; each member looks up the closest position
before it that is in a lower group, by previous-smaller pointers, and that position's prefix
grows by the member's.  So every group ends as the suffixes with one Lyndon prefix, and a scan
in suffix order then fills each group's places.  Nothing is sorted by recursion or renamed.

Groups of more than WIDE different contexts are not gathered in a task; their windows are
counted by hash instead, one row for each window, which is exact too.

Edge cases: null texts count as empty; texts shorter than SPAN bytes lose nothing; rows that
repeat id and text repeat each other's strings; other columns are not read; an empty table gives
an empty table.  Hashes have 64 bits, and contexts that meet by one are compared by bytes only
where they differ in the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Tuple  # noqa: UP035  (Spark infers the function's kind from it)

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, map_batches, materialize, release
from .word_hash import ODD, POWERS, mix

SPAN = 200
GRAM = 64
WIDE = 20_000
PLACE_BITS = 20
PIECE = 1 << 19         # window starts handled at a time; at most 2**PLACE_BITS - SPAN
MARK_BITS = 24
SEEN = 300_000          # contexts a task remembers
SUMMED = 500_000        # anchors whose contexts a task counts at a time

_U = np.uint64
VALUE = mix(np.arange(1, 257, dtype=np.uint64) * _U(ODD))


# -- anchors ------------------------------------------------------------------------------------


def anchors(data: np.ndarray):
    """For each anchor of a text: hash, hash of its context, first window, number of windows, and
    the anchor's place in the context.  `data` holds the text's bytes."""
    parts = []
    windows = len(data) - SPAN + 1
    for at in range(0, max(0, windows), PIECE):
        piece = data[at:at + PIECE + SPAN - 1]
        n = len(piece) - GRAM + 1
        POWERS.upto(len(piece) + 1)
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(VALUE[piece] * POWERS.up[:len(piece)], out=total[1:])
        grams = mix((total[GRAM:] - total[:-GRAM]) * POWERS.down[:n])
        low = _U((1 << PLACE_BITS) - 1)
        least, reach, width = (grams & ~low) | np.arange(n, dtype=np.uint64), 1, SPAN - GRAM + 1
        while reach * 2 <= width:
            least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
        if width > reach:
            least = np.minimum(least[:reach - width], least[width - reach:])
        place = (least & low).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        count = np.diff(np.concatenate([first, [len(place)]]))
        ends = first + count - 1 + SPAN
        context = mix((total[ends] - total[first]) * POWERS.down[first] + (ends - first).astype(np.uint64)
                      + (place[first] - first).astype(np.uint64) * _U(ODD))
        parts.append((grams[place[first]], context, first + at, count, place[first] - first))
    if not parts:
        return [np.zeros(0, np.int64)] * 5
    grams, context, first, count, offset = (np.concatenate(c) for c in zip(*parts))
    return grams.view(np.int64), context.view(np.int64), first, count, offset


# -- suffix arrays -------------------------------------------------------------------------------


def lyndon_groups(symbols: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Groups of the suffixes of one sequence: the group of each position, the length of each
    group's prefix (the longest Lyndon word its suffixes begin with), and the groups in
    descending order."""
    n = len(symbols)
    alphabet = sorted(set(symbols))
    number = {c: g for g, c in enumerate(alphabet)}
    group = [number[c] for c in symbols]
    members: list[list[int]] = [[] for _ in alphabet]
    for place, g in enumerate(group):
        members[g].append(place)
    length = [1] * len(alphabet)
    below = list(range(-1, len(alphabet) - 1))      # the next lower group, and the next higher
    above = list(range(1, len(alphabet) + 1))
    smaller = list(range(-1, n - 1))                # previous-smaller pointers
    done = bytearray(n + 1)                         # done[-1] stays 0: before the text
    order, current = [], len(alphabet) - 1
    while current >= 0:
        here = [p for p in members[current] if group[p] == current]
        members[current] = []
        if here:
            order.append(current)
            size = length[current]
            for p in here:
                done[p] = 1
            times: dict[int, int] = {}
            for p in here:
                q = smaller[p]
                while done[q]:
                    r = smaller[q]
                    if done[r]:
                        smaller[q] = r = smaller[r]
                    q = r
                smaller[p] = q
                if q >= 0:
                    times[q] = times.get(q, 0) + 1
            # a position followed by the group's word c times moves above those with fewer
            grown: dict[tuple[int, int], list[int]] = {}
            for q, c in times.items():
                key = (c, group[q])
                if key in grown:
                    grown[key].append(q)
                else:
                    grown[key] = [q]
            last: dict[int, int] = {}       # the topmost group put above an old one
            for c, old in sorted(grown):
                fresh, under = len(members), last.get(old, old)
                moved = grown[c, old]
                members.append(moved)
                length.append(length[old] + c * size)
                over = above[under]
                below.append(under)
                above.append(over)
                above[under] = below[over] = last[old] = fresh
                for q in moved:
                    group[q] = fresh
        current = below[current]
    return group, length, order


def suffix_array(symbols: list[int]) -> list[int]:
    """The starts of all suffixes in order; a suffix that ends first is smaller."""
    n = len(symbols)
    group, length, order = lyndon_groups(symbols)
    sizes = [0] * len(length)
    for g in group:
        sizes[g] += 1
    free, at = [0] * len(length), 0
    for g in reversed(order):
        free[g] = at
        at += sizes[g]
    # suffixes of one group are in the order of what follows their common prefix
    first, following = [-1] * (n + 1), [-1] * n
    for place, g in enumerate(group):
        end = place + length[g]
        following[place] = first[end]
        first[end] = place
    out = [0] * n
    for i in range(-1, n):
        place = first[n if i < 0 else out[i]]
        while place >= 0:
            g = group[place]
            out[free[g]] = place
            free[g] += 1
            place = following[place]
    return out


# -- one group of contexts -------------------------------------------------------------------------


def shared_length(a: bytes, b: bytes) -> int:
    """Bytes with which both begin."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low = 0
    while n - low > 1:
        middle = (low + n) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            n = middle
    return low


def longest_shared(texts: list[bytes]) -> list[int]:
    """For each text the longest beginning it shares with any other."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    out = [0] * len(texts)
    for i, j in zip(order, order[1:]):
        n = shared_length(texts[i], texts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def repeated_windows(contexts: list[tuple[bytes, int]]) -> list[list[int]]:
    """For different contexts (bytes, place of the anchor in them) of one anchor: the places of
    the windows in each that are repeated in another."""
    right = longest_shared([data[at:] for data, at in contexts])
    left = longest_shared([data[:at][::-1] for data, at in contexts])
    cut: dict[bytes, list[tuple[int, int]]] = {}
    for i, (data, at) in enumerate(contexts):
        part = data[at - left[i]:at + right[i]]
        if len(part) >= SPAN:
            cut.setdefault(part, []).append((i, at - left[i]))
    found: list[list[int]] = [[] for _ in contexts]
    texts = sorted(cut)
    flags = [bytearray(b"\1" if len(cut[t]) > 1 else b"\0") * (len(t) - SPAN + 1) for t in texts]
    if len(texts) > 1:
        starts, at = [], 0
        for text in texts:
            starts.append(at)
            at += len(text) + 1
        joined = b"\0".join(texts) + b"\0"
        symbols = np.frombuffer(joined, np.uint8).astype(np.int64) + 1
        symbols[np.array(starts[1:] + [at]) - 1] = 0
        owner = np.full(at, -1)
        for k, text in enumerate(texts):
            owner[starts[k]:starts[k] + len(text) - SPAN + 1] = k
        owner = owner.tolist()
        before = -1
        for place in suffix_array(symbols.tolist()):
            if owner[place] < 0:
                before = -1
                continue
            if before >= 0 and joined[before:before + SPAN] == joined[place:place + SPAN]:
                for p in (before, place):
                    flags[owner[p]][p - starts[owner[p]]] = 1
            before = place
    for text, flag in zip(texts, flags):
        places = [p for p, f in enumerate(flag) if f]
        for i, shift in cut[text]:
            found[i] = [p + shift for p in places]
    return found


def runs(places: list[int]):
    """(first, count) of the runs of a rising list."""
    begin = None
    for p in places:
        if begin is not None and p == end + 1:
            end = p
            continue
        if begin is not None:
            yield begin, end - begin + 1
        begin = end = p
    if begin is not None:
        yield begin, end - begin + 1


def grouped_windows(batches):
    """Contexts sorted by anchor -> runs of repeated windows (anchor, context, first, count)."""
    anchor, held = None, {}

    def done():
        keys = list(held)
        found = repeated_windows([held[k] for k in keys]) if len(keys) > 1 else []
        rows = [(anchor, key, *run) for key, places in zip(keys, found) for run in runs(places)]
        columns = zip(*rows) if rows else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                          names=["anchor", "context", "first", "count"])

    for batch in batches:
        for a, c, data, at in zip(*batch.columns):
            if a.as_py() != anchor:
                if anchor is not None:
                    yield done()
                anchor, held = a.as_py(), {}
            held[c.as_py()] = (data.as_py(), at.as_py())
    if anchor is not None:
        yield done()


# -- the operator ------------------------------------------------------------------------------------


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def marked(df: DataFrame) -> np.ndarray:
    """A table of 2**MARK_BITS bits with the bit of each `anchor` in `df` set; fixed in size."""
    slices = 256

    def run(batches):
        bits = np.zeros(1 << MARK_BITS, bool)
        for batch in batches:
            bits[mark_of(batch.column(0).to_numpy(zero_copy_only=False))] = True
        parts = np.packbits(bits).reshape(slices, -1)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())],
                                         names=["slice", "bits"])

    def unite(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for data in batch.column(1):
                part = np.frombuffer(data.as_py(), np.uint8)
                total = part if total is None else total | part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                             names=["slice", "bits"])

    out = np.zeros((slices, (1 << MARK_BITS) // 8 // slices), np.uint8)
    fields = "slice int, bits binary"
    for row in df.select("anchor").mapInArrow(run, fields).groupBy("slice").applyInArrow(unite, fields).collect():
        out[row["slice"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def mark_of(hashes: np.ndarray) -> np.ndarray:
    # mixed again: anchors are the smallest hashes around, so their leading bits are alike
    return (mix(hashes.view(np.uint64)) >> _U(64 - MARK_BITS)).astype(np.int64)


def contexts_of(docs: DataFrame, several, wide) -> DataFrame:
    """(anchor, context, data, place, wide) of the anchors marked in either table, from one pass
    over the texts; each different context once in a task."""
    def run(batches):
        narrow_bits, wide_bits = (np.unpackbits(m.value).astype(bool) for m in (several, wide))
        seen: set = set()
        for batch in batches:
            rows = []
            for text in batch.column(0):
                data = text_bytes(text.as_py())
                hashes, context, first, count, offset = anchors(data)
                if not len(hashes):
                    continue
                marks = mark_of(hashes)
                for i in np.flatnonzero(narrow_bits[marks] | wide_bits[marks]):
                    key = (int(hashes[i]), int(context[i]))
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    rows.append((*key, data[first[i]:first[i] + count[i] + SPAN - 1].tobytes(), int(offset[i]), bool(wide_bits[marks[i]])))
            if rows:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                                 names=["anchor", "context", "data", "place", "wide"])
    return docs.select("text").mapInArrow(run, "anchor bigint, context bigint, data binary, place int, wide boolean")


def context_counts(docs: DataFrame) -> DataFrame:
    """(anchor, context, n): how often each stands in the texts, summed in each task for so many
    anchors at a time."""
    def run(batches):
        held, size = [], 0

        def flush():
            pairs = np.concatenate(held)
            order = np.lexsort((pairs["c"], pairs["a"]))
            pairs = pairs[order]
            new = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
            n = np.diff(np.concatenate([new, [len(pairs)]]))
            return pa.RecordBatch.from_arrays([pa.array(pairs["a"][new]), pa.array(pairs["c"][new]), pa.array(n)],
                                              names=["anchor", "context", "n"])
        for batch in batches:
            for text in batch.column(0):
                hashes, context, *_ = anchors(text_bytes(text.as_py()))
                if len(hashes):
                    pairs = np.empty(len(hashes), [("a", np.int64), ("c", np.int64)])
                    pairs["a"], pairs["c"] = hashes, context
                    held.append(pairs)
                    size += len(pairs)
                if size >= SUMMED:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    rows = docs.select("text").mapInArrow(run, "anchor bigint, context bigint, n bigint")
    return rows.repartition("anchor").groupBy("anchor", "context").agg(F.sum("n").alias("n"))


def wide_windows(contexts: DataFrame) -> DataFrame:
    """Repeated windows of contexts in groups too large for a task, counted by window hash."""
    def make():
        def row(anchor, context, data, place):
            piece = np.frombuffer(data, np.uint8)
            total = np.zeros(len(piece) + 1, np.uint64)
            POWERS.upto(len(piece) + 1)
            np.cumsum(VALUE[piece] * POWERS.up[:len(piece)], out=total[1:])
            first = np.arange(len(piece) - SPAN + 1)
            window = mix((total[first + SPAN] - total[first]) * POWERS.down[first] + (place - first).astype(np.uint64))
            return [(anchor, context, int(f), int(w)) for f, w in zip(first, window.view(np.int64))]
        return row

    windows = map_batches(contexts, make, "anchor bigint, context bigint, first int, window bigint").distinct()
    twice = windows.groupBy("anchor", "window").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return (windows.join(twice, ["anchor", "window"])
            .select("anchor", "context", "first", F.lit(1).alias("count")))


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, hash, runs): for each document the runs of repeated windows."""
    id_type = docs.schema["doc_id"].dataType
    spark = docs.sparkSession
    of_anchor = Window.partitionBy("anchor")
    known = materialize(context_counts(docs)
                        .withColumn("places", F.sum("n").over(of_anchor)).withColumn("different", F.count("*").over(of_anchor))
                        .where("places > 1").drop("places"))
    several = spark.sparkContext.broadcast(marked(known.where(f"different between 2 and {WIDE}")))
    wide = spark.sparkContext.broadcast(marked(known.where(f"different > {WIDE}")))
    found = contexts_of(docs, several, wide)
    if wide.value.any():
        found = materialize(found)
    sorted_groups = (found.where("not wide").select("anchor", "context", "data", "place")
                     .repartition("anchor").sortWithinPartitions("anchor", "context"))
    pieces = sorted_groups.mapInArrow(grouped_windows, "anchor bigint, context bigint, first int, count int")
    if wide.value.any():
        pieces = pieces.unionByName(wide_windows(found.where("wide").drop("wide").dropDuplicates(["anchor", "context"])))
    once = materialize(pieces.groupBy("anchor", "context").agg(F.collect_list(F.struct("first", "count")).alias("parts")))
    release(spark)
    # contexts in two places are repeated whole; of the others the parts that were found
    fate = (known.select("anchor", "context", "n").join(once, ["anchor", "context"], "left")
            .where("n > 1 or parts is not null"))
    whole = F.array(F.struct(F.lit(0).alias("first"), F.col("count").alias("count")))
    hits = (_places(docs, spark.sparkContext.broadcast(marked(fate)), id_type).join(fate, ["anchor", "context"])
            .select("doc_id", "hash", "first", F.when(F.col("n") > 1, whole).otherwise(F.col("parts")).alias("parts")))
    return hits.groupBy("doc_id", "hash").agg(F.collect_list(F.struct("first", "parts")).alias("runs"))


def _places(docs: DataFrame, marks, id_type) -> DataFrame:
    """(doc_id, hash, anchor, context, first, count) of the marked anchors of every document."""
    def run(batches):
        bits = np.unpackbits(marks.value).astype(bool)
        for batch in batches:
            columns, sizes = [], []
            for text in batch.column(2):
                hashes, context, first, count, _ = anchors(text_bytes(text.as_py()))
                kept = np.flatnonzero(bits[mark_of(hashes)]) if len(hashes) else slice(0, 0)
                columns.append((hashes[kept], context[kept], first[kept], count[kept]))
                sizes.append(len(columns[-1][0]))
            owner = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            hashes, context, first, count = (np.concatenate(c) for c in zip(*columns))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(owner), batch.column(1).take(owner), pa.array(hashes, pa.int64()), pa.array(context, pa.int64()),
                 pa.array(first, pa.int64()), pa.array(count, pa.int32())],
                names=["doc_id", "hash", "anchor", "context", "first", "count"])

    return docs.select("doc_id", "hash", "text").mapInArrow(
        run, f"doc_id {id_type.simpleString()}, hash bigint, anchor bigint, context bigint, first bigint, count int")


def kept_bytes(data: bytes, windows: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """The bytes outside all windows, how many went, and in how many runs; `windows` holds runs
    (first, count) of window starts."""
    spans: list[list[int]] = []
    for first, count in sorted(windows):
        end = first + count - 1 + SPAN
        if spans and first <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([first, end])
    kept, at = [], 0
    for first, end in spans:
        kept.append(data[at:first])
        at = end
    kept.append(data[at:])
    return b"".join(kept), sum(end - first for first, end in spans), len(spans)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document, and with `with_kept`
    the remaining bytes (kept)."""
    docs = id_and_text(df, id_col, text_col).withColumn("hash", F.xxhash64("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    found = (repeated_runs(docs.where(F.octet_length("text") >= SPAN))
             .select(F.col("doc_id").alias("of"), F.col("hash").alias("of_hash"), "runs").dropDuplicates(["of", "of_hash"]))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_hash")), "left")
    fields = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def make():
        def row(doc_id, text, found_runs):
            data = text_bytes(text).tobytes()
            windows = [(r["first"] + p["first"], p["count"]) for r in found_runs or () for p in r["parts"]]
            kept, removed, spans = kept_bytes(data, windows)
            out = (doc_id, len(data), removed, spans, hashlib.sha256(kept).hexdigest())
            return [out + (kept,) if with_kept else out]
        return row

    return map_batches(joined.select("doc_id", "text", "runs"), make, fields + (", kept binary" if with_kept else ""))
