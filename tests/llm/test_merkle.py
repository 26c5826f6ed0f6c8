"""Operator 13 against a tree built in one place."""
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from proflex.llm import merkle as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(leaves, fanout):
    """(root, proofs): each proof is a list of (before, after)."""
    proofs, owners, nodes = [[] for _ in leaves], [[i] for i in range(len(leaves))], list(leaves)
    while len(nodes) > 1:
        above, held = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at:at + fanout]
            for j in range(len(run)):
                for i in owners[at + j]:
                    proofs[i].append(("".join(run[:j]), "".join(run[j + 1:])))
            above.append(digest(*run))
            held.append(sum(owners[at:at + fanout], []))
        nodes, owners = above, held
    return nodes[0], proofs


def brute(rows, fanout):
    rows = sorted(rows, key=lambda r: (r[2] is not None, (r[2] or "").encode(), r[0] is not None, r[0] or 0, leaf(*r)))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    inner = [tree([leaf(*r) for r in g], fanout) for g in groups.values()]
    root, upper = tree([i[0] for i in inner], fanout)
    out = []
    for g, (sub, proofs), above in zip(groups.values(), inner, upper):
        for r, proof in zip(g, proofs):
            bad = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None:
                bad[4] += 1
            node = leaf(*bad)
            for before, after in proof + above:
                node = digest(before, node, after)
            out.append((r[0], leaf(*r), sub, root, digest(*[b + a for b, a in proof + above]), node, node == root))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("fanout,levels", [(2, 12), (2, 2), (3, 1)])
def test_given_table(spark, fanout, levels):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = M.verify_documents(df, fanout, levels)
    assert out.columns == COLUMNS
    rows = [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert order(tuple(r) for r in out.collect()) == order(brute(rows, fanout))


@pytest.mark.parametrize("n", [1, 3, 9, 17])
def test_ragged_groups(spark, n):
    rng = random.Random(n)
    rows = [(i, f"é{i}" * rng.randrange(4), "en", None, i) for i in range(n)]
    rows += [(None, None, None, None, None), (7, "x", None, "s", 1), (7, "x", None, "s", 1), (7, "y", None, "s", None), (8, "z" * 1_000_000, "Ä", "", 0), (9, "", "", "a", 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("grp", F.lit(1)).withColumn("leaf", F.lit("x")).withColumn("path", F.lit(2))
    got = [tuple(r) for r in M.verify_documents(df, 2, 1).collect()]
    assert order(got) == order(brute(rows, 2))


def test_empty(spark):
    out = M.verify_documents(spark.createDataFrame([], SCHEMA))
    assert out.columns == COLUMNS and out.count() == 0


def test_proofs_are_real(spark):
    rows = spark.createDataFrame([(i, "ab"[i % 2], digest(str(i))) for i in range(21)], "id long, part string, leaf string")
    for r in M.manifest(rows, "id", "part", fanout=3, levels=1).collect():
        node = r.leaf
        for s in r.proof:
            node = digest(s.before, node, s.after)
        assert node == r.root
