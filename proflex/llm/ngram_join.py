"""Operator 4: n-gram Jaccard join with R-trees of count vectors.

A document's set holds the hashes of its distinct word n-grams.  Documents with equal sets form
a class, which is compared once; two classes link when PERCENT or more of the union of their
sets is in both.

Count vectors.  Each hash falls into one of GROUPS groups; how many of a set's hashes fall into
each is a point.  The overlap of two sets is at most the sum of the smaller coordinates of
their points, and of two boxes of points at most the sum over the smaller upper corners.

Distribution.  No split of the space keeps all partners together, as a partner may differ in any
coordinate by a sixth of the set.  So the classes are dealt to a forest of trees, one for each
prefix n-gram: in a common order of n-grams, two sets that overlap enough share one among the
first n - ceil(0.85 n) + 1 of each (prefix filter, exact).  The order puts n-grams with small
counts first, from a fixed-size table of counts over all documents, so passages that many
documents share seldom deal out anything.  A tree of more than TILE points is split into tiles,
and each pair of tiles is a task of its own.

1. Nearby: among the first PROBES prefix n-grams each class meets one other class of its tree;
   the best by the count bound is verified, and union-find merges what linked.  STARS - 1 times
   more, in all trees that hold several components, each class meets one class of another
   component: so a large group of near copies becomes one component at a few verifications each.
2. Join: trees that still hold several components are joined with themselves.  Boxes whose bound
   or size rules out every pair are skipped, points of one component also; a pair in several trees
   above LEAF points comes out of the smallest.  The pairs left are verified on the exact sets.  Union-find over all links gives the components.

The result is components, not links: points already in one component are never compared, so
most links inside a component are not found, while no two components with a link between them
stay apart.  Copies are never expanded into pairs.  Sets are
recomputed from the text only for classes with a candidate; which documents these are is told to
the tasks by a table of bits of fixed size, whose errors a join corrects.

Hashes have 64 bits; classes are told apart by a 64-bit digest of the set.

Edge cases: null, empty and blank texts have an empty set, link with nothing and are their own
component; repeated rows and equal texts are one class; null ids take the smallest other id of
their component, or stay null; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from typing import Tuple  # noqa: UP035  (Spark infers the function's kind from it)

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import id_and_text, map_batches, materialize, release
from .components import connected_components
from .word_hash import mix, shingle_hashes

WORDS = 4
PERCENT = 85
GROUPS = 256
PROBES = 4
TILE = 2048
STARS = 3           # rounds in which a class meets one class of each of its trees
LEAF = 32
SEEN = 500_000      # classes a task remembers
SLICES = 64
CELL_BITS = 18      # cells of the table of counts; of bits, eight times as many


def least_overlap(total, percent: int = PERCENT):
    """The smallest overlap with which sets of `total` members together still link."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def count_vector(hashes: np.ndarray) -> np.ndarray:
    return np.bincount((hashes >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS)


def packed(vector: np.ndarray) -> bytes:
    """A count vector in the narrowest unsigned type that holds it."""
    most = vector.max()
    return vector.astype("<u1" if most < 256 else "<u2" if most < 65536 else "<u4").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{len(data) // GROUPS}")


# -- tables of fixed size, summed over all tasks --------------------------------------------


def add_up(parts: DataFrame, kind, size: int) -> np.ndarray:
    """Sum of tables sent as (slice, counts), slice by slice; `size` counts reach the driver."""
    def add(key: Tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // SLICES, np.int64)
        for batch in batches:
            for data in batch.column(1):
                total += np.frombuffer(data.as_py(), kind)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["slice", "counts"])

    out = np.zeros((SLICES, size // SLICES), np.int64)
    for row in parts.groupBy("slice").applyInArrow(add, "slice int, counts binary").collect():
        out[row["slice"]] = np.frombuffer(row["counts"], np.int64)
    return out.reshape(-1)


def marked(keys: DataFrame, bits: int) -> np.ndarray:
    """A table of 2**bits flags: the cells of the hashed `key`s; fixed in size."""
    def run(batches):
        flags = np.zeros(1 << bits, np.uint8)
        for batch in batches:
            flags[cells(mix(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)), bits)] = 1
        parts = flags.reshape(SLICES, -1)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([parts[i].tobytes() for i in used], pa.binary())],
                                         names=["slice", "counts"])

    return add_up(keys.select("key").mapInArrow(run, "slice int, counts binary"), np.uint8, 1 << bits) > 0


def cells(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def describe(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, np.ndarray]:
    """One pass over the texts: for each document its id, the size of its set, class and count
    vector; and how often the n-grams of each cell stand in documents, over all documents.  Each
    task sends its table of counts once, in slices that are summed by slice."""
    id_type = docs.schema["doc_id"].dataType
    schema = StructType.fromDDL(f"doc_id {id_type.simpleString()}, n bigint, class bigint, vector binary, slice int, counts binary")
    arrow = to_arrow_schema(schema)

    def run(batches):
        counts = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            rows, used = [], []
            for doc_id, text in zip(*batch.columns):
                hashes = shingle_hashes(text.as_py() or "", words)
                if len(hashes):
                    used.append(cells(mix(hashes), CELL_BITS))
                    rows.append((doc_id.as_py(), len(hashes), class_of(hashes), packed(count_vector(hashes)), None, None))
                else:
                    rows.append((doc_id.as_py(), 0, None, None, None, None))
            if used:
                counts += np.bincount(np.concatenate(used), minlength=len(counts)).astype(np.uint32)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)
        parts = counts.reshape(SLICES, -1)
        rows = [(None, None, None, None, int(i), parts[i].tobytes()) for i in np.flatnonzero(parts.any(1))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), arrow)], schema=arrow)

    rows = materialize(docs.mapInArrow(run, schema))
    table = add_up(rows.where("slice is not null").select("slice", "counts"), np.uint32, 1 << CELL_BITS)
    return rows.where("slice is null").select("doc_id", "n", "class", "vector"), np.minimum(table, 0xFFFFFFFF).astype(np.uint32)


def ordered_prefix(hashes: np.ndarray, ranks: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The prefix of a set in the common order, ascending: an n-gram stands as the count of its cell
    before the last bits of its hash.  N-grams that fall together share a tree, which adds points to
    it and loses none: the first of the members that two sets share has one number in both."""
    mixed = mix(hashes)
    counts = np.minimum(ranks[cells(mixed, CELL_BITS)], 0xFFFFFF).astype(np.uint64)
    numbers = (counts << np.uint64(40)) | (mixed & np.uint64((1 << 40) - 1))
    m = prefix_length(len(hashes), percent)
    return np.sort(np.partition(numbers, m - 1)[:m])


# -- the R-tree ---------------------------------------------------------------------------------


class CountTree:
    """Points packed into leaves by size and coarse coordinates, with the leaves' upper corners."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, classes: np.ndarray, components: np.ndarray):
        coarse = points.reshape(len(points), 4, -1).sum(2)
        order = np.lexsort((*coarse.T, np.log2(np.maximum(sizes, 1)) * 8 // 1))
        self.points, self.sizes = points[order], sizes[order]
        self.classes, self.components = classes[order], components[order]
        self.starts = np.arange(0, len(order), LEAF)
        self.upper = np.maximum.reduceat(self.points, self.starts, axis=0)
        self.small = np.minimum.reduceat(self.sizes, self.starts)
        self.large = np.maximum.reduceat(self.sizes, self.starts)
        low = np.minimum.reduceat(self.components, self.starts)
        self.only = np.where(low == np.maximum.reduceat(self.components, self.starts), low, -1)


def tree_join(one: CountTree, two: CountTree, same: bool, percent: int = PERCENT):
    """(class, class) of the points of different components that the bound cannot rule out."""
    for i, start in enumerate(one.starts):
        fits = (100 * one.large[i] >= percent * two.small) & (100 * two.large >= percent * one.small[i])
        fits &= np.minimum(one.upper[i], two.upper).sum(1) >= least_overlap(one.small[i] + two.small, percent)
        if one.only[i] >= 0:
            fits &= two.only != one.only[i]
        if same:
            fits[:i] = False
        here = slice(start, start + LEAF)
        for j in np.flatnonzero(fits):
            there = slice(two.starts[j], two.starts[j] + LEAF)
            bound = np.minimum(one.points[here, None], two.points[None, there]).sum(2)
            close = bound >= least_overlap(one.sizes[here, None] + two.sizes[None, there], percent)
            close &= one.components[here, None] != two.components[None, there]
            if same and i == j:
                close = np.triu(close, 1)
            for a, b in zip(*np.nonzero(close)):
                yield one.classes[start + a], two.classes[two.starts[j] + b]


@cache
def both_ends(m: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(m, 1)


def leaf_join(rows: list[tuple], percent: int = PERCENT):
    """What `tree_join` finds in a tree of one leaf: its pairs at once, without corners."""
    sizes, classes, components = (np.array([r[c] for r in rows], np.int64) for c in (6, 4, 5))
    i, j = both_ends(len(rows))
    fits = (components[i] != components[j]) & (np.minimum(sizes[i], sizes[j]) >= least_overlap(sizes[i] + sizes[j], percent))
    i, j = i[fits], j[fits]
    if len(i):
        width = max(len(r[7]) for r in rows) // GROUPS
        points = np.array([unpacked(r[7]) for r in rows], f"<u{width}")
        close = np.minimum(points[i], points[j]).sum(1, np.int64) >= least_overlap(sizes[i] + sizes[j], percent)
        i, j = i[close], j[close]
    return zip(classes[i].tolist(), classes[j].tolist())


def tile_pairs(batches, percent: int = PERCENT):
    """Join the tile pairs of a partition sorted by (tree, tile_a, tile_b)."""
    key, rows = None, []

    def pairs_of(found):
        pairs = sorted({(int(min(p)), int(max(p))) for p in found})
        return [p[0] for p in pairs], [p[1] for p in pairs]

    def joined():
        if key[1] == key[2] and len(rows) <= LEAF:
            return pairs_of(first_met(leaf_join(rows, percent)))
        left = [r for r in rows if r[3]]
        right = [r for r in rows if not r[3]]
        trees = []
        for part in (left, right):
            if part:
                width = max(len(r[7]) for r in part) // GROUPS
                points = np.array([unpacked(r[7]) for r in part], f"<u{width}").astype(np.int32)
                trees.append(CountTree(points, *(np.array([r[c] for r in part], np.int64) for c in (6, 4, 5))))
        if key[1] == key[2]:
            found = tree_join(trees[0], trees[0], True, percent)
        elif len(trees) == 2:
            found = tree_join(trees[0], trees[1], False, percent)
        else:
            return [], []
        return pairs_of(first_met(found))

    def batch_of(pairs):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in pairs], names=["a", "b"])

    def first_met(found):
        """The pairs that no smaller one of the trees with lists holds; in trees without, all."""
        lower = {r[4]: frozenset(r[8] or ()) for r in rows}
        return ((a, b) for a, b in found if lower[a].isdisjoint(lower[b]))

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:3] != key:
                if rows:
                    yield batch_of(joined())
                key, rows = row[:3], []
            rows.append(row)
    if rows:
        yield batch_of(joined())


# -- the join -------------------------------------------------------------------------------------


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose exact sets link."""
    of_a = sets.select(F.col("class").alias("a"), F.col("members").alias("set_a"))
    of_b = sets.select(F.col("class").alias("b"), F.col("members").alias("set_b"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(of_a, "a").join(of_b, "b")
            .where((100 + percent) * both >= percent * (F.size("set_a") + F.size("set_b"))).select("a", "b"))


def class_of(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def sets_of(docs: DataFrame, wanted: DataFrame, words: int = WORDS) -> DataFrame:
    """(class, members) for the `wanted` (class, doc) rows, from one pass over the texts."""
    bits = CELL_BITS + 3
    keyed = docs.withColumn("key", F.xxhash64("doc_id"))
    told = docs.sparkSession.sparkContext.broadcast(np.packbits(marked(wanted.select(F.xxhash64("doc").alias("key")), bits)))

    def make():
        held = np.unpackbits(told.value)

        def row(key, text):
            if not held[cells(mix(np.array([key], np.int64).view(np.uint64)), bits)[0]]:
                return ()
            hashes = shingle_hashes(text or "", words)
            return [(class_of(hashes), hashes.view(np.int64).tolist())] if len(hashes) else ()
        return row

    found = map_batches(keyed.select("key", "text"), make, "class bigint, members array<bigint>")
    return materialize(found.join(wanted.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"]))


def ngram_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                     percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; sets of `words`-grams link when
    `percent` of their union is in both."""
    spark = df.sparkSession
    docs = id_and_text(df, id_col, text_col)
    described, counts = describe(docs, words)
    ranks = spark.sparkContext.broadcast(counts)
    full = described.where("n > 0")
    classes = full.groupBy("class").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"))
    vectors = materialize(full.select("class", "n", "vector").dropDuplicates(["class"]))

    def deal(batches):
        seen: set[int] = set()      # copies within a task are dealt once
        for batch in batches:
            tokens, numbers, sizes = [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py() or "", words)
                number = class_of(hashes)
                if not len(hashes) or number in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(number)
                tokens.append(ordered_prefix(hashes, ranks.value, percent).view(np.int64))
                numbers.append(number)
                sizes.append(len(tokens[-1]))
            if tokens:
                columns = (np.concatenate(tokens), np.repeat(np.array(numbers, np.int64), sizes),
                           np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "class", "place"])

    dealt = (docs.mapInArrow(deal, "token bigint, class bigint, place int").repartition("token")
             .groupBy("token", "class").agg(F.min("place").alias("place")))
    of_token = Window.partitionBy("token")
    trees = materialize(dealt.withColumn("low", F.min("class").over(of_token)).withColumn("high", F.max("class").over(of_token))
                        .where("low <> high").select("token", "class", "place"))

    of_a = vectors.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.col("vector").alias("vector_a"))
    of_b = vectors.select(F.col("class").alias("b"), F.col("n").alias("n_b"), F.col("vector").alias("vector_b"))

    def bounds():
        def row(a, b, n_a, vector_a, n_b, vector_b):
            bound = int(np.minimum(unpacked(vector_a), unpacked(vector_b)).sum())
            return [(a, b, bound / (n_a + n_b))] if bound >= least_overlap(n_a + n_b, percent) else ()
        return row

    def star(points: DataFrame, salt: int) -> DataFrame:
        """Links of each class with the best by the bound among one class of another component in each
        of its trees; `points` has token, class and component."""
        heads = (points.groupBy("token").agg(F.min_by(F.struct("class", "component"), F.xxhash64("class", "token", F.lit(salt))).alias("head")))
        pairs = (points.join(heads, "token").where("component <> head.component")
                 .select(F.col("class").alias("a"), F.col("head.class").alias("b")).distinct())
        bounded = map_batches(pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "n_a", "vector_a", "n_b", "vector_b"),
                              bounds, "a bigint, b bigint, share double")
        best = materialize(bounded.groupBy("a").agg(F.max(F.struct("share", "b")).alias("best"))
                           .select("a", F.col("best.b").alias("b")))
        return materialize(verified(best, _wanted_sets(docs, best, classes, words), percent))

    def still_mixed(points: DataFrame, links: DataFrame) -> DataFrame:
        """The points of the trees that hold several components; a tree of one keeps to one."""
        merged = connected_components(links).withColumnRenamed("node", "class")
        held = (points.select("token", "class", "place").join(merged, "class", "left")
                .select("token", "class", "place", F.coalesce("component", "class").alias("component")))
        several = (held.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m"))
                   .where("low <> high").select("token", "m"))
        return materialize(held.join(several, "token"))

    # 1. nearby: a few rounds in which each class meets the best of one class from each tree
    links = star(trees.where(F.col("place") < PROBES).withColumn("component", F.col("class")), 0)
    mixed = still_mixed(trees, links)
    release(spark)
    for salt in range(1, STARS):
        links = materialize(links.union(star(mixed, salt)))
        mixed = still_mixed(mixed, links)
        release(spark)

    # 2. join of the trees that still hold several components, each by itself
    tiles = F.ceil(F.col("m") / TILE).cast("int")
    # near copies share most of their trees; of the trees above LEAF points, only the smallest that
    # holds both classes gives a pair, so their points know the smaller ones of the class
    large = mixed.where(F.col("m") > LEAF).groupBy("class").agg(F.collect_set("token").alias("large"))
    mixed = mixed.join(large, "class", "left").withColumn(
        "lower", F.when(F.col("m") > LEAF, F.filter("large", lambda t: t < F.col("token"))))
    # each point goes to every pair of tiles that its own tile is part of
    points = (mixed.withColumn("tiles", tiles).join(vectors, "class")
              .withColumn("tile", F.pmod(F.xxhash64("class"), F.col("tiles")).cast("int"))
              .withColumn("other", F.explode_outer(F.sequence(F.lit(0), F.col("tiles") - 1)))
              .select(F.col("token").alias("tree"), F.least("tile", "other").alias("tile_a"), F.greatest("tile", "other").alias("tile_b"),
                      (F.col("tile") <= F.col("other")).alias("left"), "class", "component", "n", "vector", "lower"))
    unit = ["tree", "tile_a", "tile_b"]
    across = materialize(points.repartition(*unit).sortWithinPartitions(*unit)
                         .mapInArrow(lambda batches: tile_pairs(batches, percent), "a bigint, b bigint").distinct())
    more = materialize(verified(across, _wanted_sets(docs, across, classes, words), percent))
    final = connected_components(links.union(more))
    release(spark)

    component = (classes.join(final.withColumnRenamed("node", "class"), "class", "left")
                 .select("class", "doc", F.coalesce("component", "class").alias("component")))
    smallest = component.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_class = component.join(smallest, "component").select("class", "component_id")
    return (described.join(of_class, "class", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def _wanted_sets(docs: DataFrame, pairs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    ends = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    return sets_of(docs, materialize(classes.join(ends, "class").select("class", "doc")), words)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, without those whose component has a smaller id.
    Rows that repeat an id share its fate; null ids stay."""
    gone = (ngram_components(df, id_col, text_col, words, percent).where("component_id < doc_id")
            .select(F.col("doc_id").alias("_gone")).distinct())
    return df.join(gone, F.col(id_col) == F.col("_gone"), "left_anti")
