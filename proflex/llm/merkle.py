"""Operator 13: Merkle manifest of a dataset, upper levels by butterfly exchange.

Each row is a leaf, the digest of its fields.  The leaves of a group, in order of their key, are
hashed in runs of `fanout` (the last may be shorter, even a single node) until one node remains, the
subroot; the subroots, in order of the group, likewise give the root.  Digests are lower-case hex
SHA-256, hashed as text.

1. Ranks.  Leaves are dealt by ranges of (group, key, leaf); sums of the partitions' counts turn
   places within a partition into places within the group, so no group need stand in one task.
2. Blocks.  `fanout ** levels` neighbouring leaves are an aligned block, hashed within a task.
3. Butterfly.  In round r every block holds the node above it at height r and asks one block of each
   sibling subtree for theirs: blocks that differ in digit r of their number swap, and where the last
   subtree is ragged its blocks take turns.  Each block hashes the node above for itself.  After the
   last round every block holds the whole path to the subroot: no pass leads down again.  A round is
   one join of rows of a digest each, written to the shared folder.
4. Subroots are leaves of a second tree of the same kind; their proofs continue those of their groups.
   The blocks then give each leaf its proof, as (before, after): the digests of its siblings in front
   and behind, joined, from its run up to the root; a run of one has a step without siblings.

Edge cases: a null in any field is hashed as `-`, and a null group is a group of its own, before all
others; null keys come first; rows of equal key follow by leaf; repeated rows are leaves of their own,
with proofs of their own; a group of one has its leaf as subroot, and a table of one group its subroot
as root; long texts are hashed where they are read, and only digests are dealt; other columns are not
read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_stream, materialize

FANOUT = 2
LEVELS = 12         # levels below a block's root, so a block has FANOUT ** LEVELS leaves


def digest_of(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(column: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hash_text(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str], fanout: int) -> list[str]:
    """The next level."""
    return [hash_text(*nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)]


def _levels_of(n: int, fanout: int, levels: int) -> int:
    """Levels of a block in a group of n leaves: all of them, or as many as end in one node."""
    size, height = n, 0
    while size > 1 and height < levels:
        size, height = -(-size // fanout), height + 1
    return height


def ranked(leaves: DataFrame, order: list[str]) -> DataFrame:
    """`leaves` (grp, leaf, and the rest) with place and n, the size of the group."""
    dealt = leaves.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order)
    # numbers of a partition's rows: the partition in the upper bits
    held = materialize(dealt.select("*", F.monotonically_increasing_id().alias("_at"))
                       .withColumn("_part", F.shiftright("_at", 33)))
    parts = held.groupBy("grp", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of_group = Window.partitionBy("grp")
    parts = materialize(parts.select("grp", "_part", "_first", F.sum("_n").over(of_group).alias("n"), (F.sum("_n").over(
        of_group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before")))
    return (held.join(parts, ["grp", "_part"])
            .withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
            .drop("_at", "_part", "_first", "_before"))


def butterfly(blocks: DataFrame, fanout: int) -> DataFrame:
    """(grp, block, path, top): the proof steps above each block and the group's last node; `blocks`
    has grp, block, m (blocks of the group) and node."""
    steps = "array<struct<before:string,after:string>>"
    state = blocks.select("grp", "block", "m", "node", F.array().cast(steps).alias("path"))
    most = state.agg(F.max("m")).first()[0] or 0
    width = 1
    while width < most:
        own = F.floor(F.col("block") / width)
        asked = F.sequence(own - own % fanout, F.least(own - own % fanout + fanout, F.ceil(F.col("m") / width)) - 1)
        # the nodes of the run but the own; of the blocks below each, one answers
        open_ = F.col("m") > width
        asks = (state.where(open_).select("grp", "block", "m", own.alias("own"), F.explode(asked).alias("sibling"))
                .where("sibling <> own")
                .withColumn("answers", F.least(F.lit(width), F.col("m") - F.col("sibling") * width))
                .select("grp", "block", "own", "sibling", (F.col("sibling") * width + F.col("block") % width % F.col("answers")).alias("_other")))
        told = state.select(F.col("grp").alias("_grp"), F.col("block").alias("_block"), F.col("node").alias("said"))
        answers = asks.join(told, (F.col("grp") == F.col("_grp")) & (F.col("_other") == F.col("_block")))
        # at most fanout - 1 digests each
        run = answers.groupBy("grp", "block").agg(F.sort_array(F.collect_list(F.struct("sibling", "said", "own"))).alias("run"))

        def side(keep):
            return F.array_join(F.transform(F.filter(F.coalesce("run", F.array().cast("array<struct<sibling:bigint,said:string,own:bigint>>")), keep),
                                            lambda s: s["said"]), "")

        both = state.join(run, ["grp", "block"], "left").select(
            "grp", "block", "m", "node", "path", open_.alias("open"), side(lambda s: s["sibling"] < s["own"]).alias("before"),
            side(lambda s: s["sibling"] > s["own"]).alias("after"))
        state = materialize(both.select(
            "grp", "block", "m", F.when(F.col("open"), digest_of(F.col("before"), F.col("node"), F.col("after"))).otherwise(F.col("node")).alias("node"),
            F.when(F.col("open"), F.concat("path", F.array(F.struct("before", "after")))).otherwise(F.col("path")).alias("path")))
        width *= fanout
    return state.select("grp", "block", "path", F.col("node").alias("top"))


def forest(leaves: DataFrame, order: list[str], keep: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Trees over the groups of `leaves` (grp string, leaf hex, and the columns of `order` and `keep`):
    a row (grp, n, block, members, path, top, tops) for each block, with all above it known.  `proofs`
    unpacks it."""
    size = fanout ** levels
    places = ranked(leaves, order).withColumn("block", F.floor(F.col("place") / size))
    # a block's rows meet in one task; their number is bounded by `size`
    members = F.sort_array(F.collect_list(F.struct("place", "leaf", *keep)))
    packed = materialize(places.groupBy("grp", "n", "block").agg(members.alias("members")))

    def make():
        def run(rows):
            for grp, block, n, leaves in rows:
                nodes = leaves
                for _ in range(_levels_of(n, fanout, levels)):
                    nodes = climb(nodes, fanout)
                yield grp, block, -(-n // size), nodes[0]
        return run

    roots = map_stream(packed.select("grp", "block", "n", "members.leaf"), make, "grp string, block bigint, m bigint, node string")
    paths = butterfly(materialize(roots), fanout)
    return packed.join(paths, ["grp", "block"]).withColumn("tops", F.array("top"))


def proofs(blocks: DataFrame, keep: list[str], fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """grp, leaf, the `keep` columns, proof (from the leaf's run to the end of the block's path) and
    tops of every leaf."""
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema["members"].dataType.elementType.fields}
    fields = ", ".join(["grp string", "leaf string", *[f"{c} {kinds[c]}" for c in keep],
                        "proof array<struct<before:string,after:string>>", "tops array<string>"])

    def make():
        def run(rows):
            for grp, n, members, path, tops in rows:
                leaves = [m["leaf"] for m in members]
                levels_here = [leaves]
                for _ in range(_levels_of(n, fanout, levels)):
                    levels_here.append(climb(levels_here[-1], fanout))
                above = [(s["before"], s["after"]) for s in path]
                for i, member in enumerate(members):
                    proof, own = [], i
                    for nodes in levels_here[:-1]:
                        first = own - own % fanout
                        proof.append(("".join(nodes[first:own]), "".join(nodes[own + 1:first + fanout])))
                        own //= fanout
                    yield (grp, member["leaf"], *[member[c] for c in keep], proof + above, tops)
        return run

    return map_stream(blocks.select("grp", "n", "members", "path", "tops"), make, fields)


def manifest(rows: DataFrame, key: str, group: str, keep: list[str] = (), fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The manifest of `rows`, which has `key`, `group`, `leaf` and the `keep` columns: one row for each
    leaf with key, keep, leaf, subroot, root and proof (steps from the leaf to the root)."""
    keep = list(keep)
    # null before all values, and values by their bytes
    grp = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(grp.alias("grp"), F.col(key).alias("key"), "leaf", *[F.col(c).alias(f"keep_{c}") for c in keep])
    names = ["key", *[f"keep_{c}" for c in keep]]
    trees = materialize(forest(leaves, ["key", "leaf"], names, fanout, levels))
    subroots = trees.where("block = 0").select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("top").alias("leaf"))
    above = materialize(proofs(forest(subroots, ["name"], ["name"], fanout, levels), ["name"], fanout, levels)
                        .select("name", F.col("proof").alias("upper"), F.col("tops").alias("root")))
    whole = (trees.join(above, F.col("grp") == F.col("name"))
             .withColumn("path", F.concat("path", "upper")).withColumn("tops", F.concat("tops", "root")))
    found = proofs(whole, names, fanout, levels)
    return found.select(F.col("key").alias(key), *[F.col(f"keep_{c}").alias(c) for c in keep], "leaf",
                        F.col("tops")[0].alias("subroot"), F.col("tops")[1].alias("root"), "proof")


def proof_digest(proof: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    return F.aggregate(proof, leaf, lambda node, s: digest_of(s["before"], node, s["after"]))


DOCUMENT_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf_of(fields: dict[str, Column]) -> Column:
    return digest_of(*[field(c) for c in fields.values()])


def verify_documents(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The registered query: the manifest of `documents`, and what its proofs say of tampered rows."""
    fields = {c: F.col(c) for c in DOCUMENT_FIELDS}
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    tampered = leaf_of(fields | {"n_chars": F.col("n_chars") + 1})
    rows = docs.select("doc_id", "lang", leaf_of(fields).alias("leaf"),
                       F.when(chosen & F.col("n_chars").isNotNull(), tampered).alias("tampered"))
    found = manifest(rows, "doc_id", "lang", ["tampered"], fanout, levels)
    folded = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"),
                          fold(F.coalesce("tampered", "leaf"), F.col("proof")).alias("folded_root"))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
