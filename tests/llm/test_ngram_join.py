"""Operator 4 against all pairs of exact sets."""
import random
import re

import numpy as np
import pytest

from proflex.llm import ngram_join as N
from proflex.llm import word_hash


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def gram_set(text):
    w = words_of(text)
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} or ({tuple(w)} if w else set())


def brute(docs):
    sets = [(d, gram_set(t)) for d, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (_, a) in enumerate(sets):
        for j, (_, b) in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)]) for i, (d, s) in enumerate(sets)}


def corpus(seed, groups=8, copies=12):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdéß") for _ in range(rng.randint(1, 6))) for _ in range(500)]
    common = " ".join(rng.choice(vocabulary) for _ in range(40))
    docs, number = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 40, 120, 300]))]
        for _ in range(rng.randint(1, copies)):
            words = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "\t "]).join(words)
            if rng.random() < 0.3:
                text += " " + common
            docs.append((number * 7 % 1000, rng.choice([text, text, text.upper() if text.isascii() else text])))
            number += 1
    return docs


def test_hashes_equal_sets():
    rng = random.Random(2)
    for d, text in corpus(5) + [(0, ""), (0, " \n"), (0, "x"), (0, "x" * 500 + " y"), (0, "a b c\x1cd")]:
        assert len(word_hash.shingle_hashes(text, 4)) == len(gram_set(text))
        mixed = "\t" + text.replace(" ", rng.choice(["  ", "\n"])) + " "
        assert np.array_equal(word_hash.shingle_hashes(mixed, 4), word_hash.shingle_hashes(text, 4))


def test_word_keys_tell_words_apart():
    """Words of any length, with and without zero bytes, in texts with blanks at both ends or none."""
    rng = random.Random(4)
    words = {"".join(rng.choice("ab\xe9\u20ac\U0001f600") for _ in range(rng.randint(1, 12))) for _ in range(3000)}
    words |= {"", *("a" * i for i in range(1, 60)), "abcdefgh", "abcdefghi"} - {""}
    alone = {w: word_hash.word_keys(w).tolist() for w in words}
    assert all(len(k) == 1 for k in alone.values()) and len({k[0] for k in alone.values()}) == len(words)
    for first, last in (("", ""), (" \n", "\t"), ("", "\x0b ")):
        row = rng.sample(sorted(words), 200)
        text = first + "".join(w + rng.choice([" ", "\n\t", "\x0c\r "]) for w in row[:-1]) + row[-1] + last
        assert word_hash.word_keys(text.upper() if text.isascii() else text).tolist() == [alone[w][0] for w in row]
    assert [len(word_hash.word_keys(t)) for t in ("", " ", "\n \t", "\0", "a\0 b")] == [0, 0, 0, 1, 2]


def test_equal_words_behind_a_zero_byte_elsewhere():
    plain, zero = "one two three four", "one two three four x\0"
    assert len(np.intersect1d(word_hash.shingle_hashes(plain, 4), word_hash.shingle_hashes(zero, 4))) == 1


def test_prefixes_of_sets_that_link_meet():
    """In the common order of numbers, with many n-grams in few cells of the table and few hash bits apart."""
    rng = np.random.default_rng(7)
    ranks = rng.choice(np.array([1, 2, 0xFFFFFFFF], np.uint32), 1 << N.CELL_BITS)
    for _ in range(300):
        one = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 80)).astype(np.uint64))
        two = np.unique(np.concatenate([one[rng.random(len(one)) < 0.92], rng.integers(0, 1 << 63, 2).astype(np.uint64)]))
        both = len(np.intersect1d(one, two))
        if 100 * both >= 85 * (len(one) + len(two) - both):
            assert len(np.intersect1d(N.ordered_prefix(one, ranks), N.ordered_prefix(two, ranks)))


def test_leaf_join_finds_what_the_tree_finds():
    rng = np.random.default_rng(5)
    for m in (1, 2, 3, 9, N.LEAF):
        for factor in (1, 300):
            base = rng.integers(0, 3, N.GROUPS)
            points = [(base + (rng.random(N.GROUPS) < rng.choice([0.02, 0.2, 0.6]))) * factor for _ in range(m)]
            rows = [(0, 0, 0, True, 100 + i, int(rng.integers(0, 4)), int(p.sum()), N.packed(p)) for i, p in enumerate(points)]
            tree = N.CountTree(np.array(points, np.int32), *(np.array([r[c] for r in rows], np.int64) for c in (6, 4, 5)))
            expected = {tuple(sorted(map(int, p))) for p in N.tree_join(tree, tree, True)}
            assert {tuple(sorted(p)) for p in N.leaf_join(rows)} == expected


def test_pairs_of_large_trees_come_once():
    """40 points in three trees: each pair comes from the smallest tree that holds both, tiles or not."""
    import pyarrow as pa
    trees = {5: range(0, 38), 6: range(2, 40), 9: range(0, 40)}
    vector = N.packed(np.ones(N.GROUPS, np.int64))
    names = ["tree", "tile_a", "tile_b", "left", "class", "component", "n", "vector", "lower"]

    def found(tiles):
        rows = []
        for tree, classes in trees.items():
            for c in classes:
                lower = [t for t, held in trees.items() if t < tree and c in held]
                for other in range(tiles):
                    tile = c % tiles
                    rows.append((tree, min(tile, other), max(tile, other), tile <= other, c, c, N.GROUPS, vector, lower))
        rows.sort(key=lambda r: r[:3])
        batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
        return [p for out in N.tile_pairs([batch]) for p in zip(*(c.to_pylist() for c in out.columns))]

    every = [(a, b) for a in range(40) for b in range(a + 1, 40)]
    assert sorted(found(1)) == sorted(found(3)) == every


def test_long_words_of_two_letters(spark):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    docs = []
    for bits in (10, 11, 14):
        word = "".join("ab"[bin(i).count("1") % 2] for i in range(1 << bits))
        docs += [(len(docs), word), (len(docs) + 1, word.translate(str.maketrans("ab", "ba")))]
    docs.append((9, docs[0][1].upper()))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(tuple(r) for r in N.ngram_components(df).collect()) == [*[(i, 1, i) for i in range(6)], (9, 1, 0)]


def test_tree_bound_loses_nothing():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(5, 300)).astype(np.uint64) * np.uint64(2)) for _ in range(40)]
    for i in range(60):
        base = sets[i % 40]
        keep = rng.random(len(base)) < rng.choice([0.8, 0.9, 0.95])
        sets.append(np.unique(np.concatenate([base[keep], rng.integers(0, 1 << 63, 3).astype(np.uint64)])))
    points = np.array([N.count_vector(s) for s in sets]).astype(np.int32)
    sizes, ids = np.array([len(s) for s in sets]), np.arange(len(sets))
    tree = N.CountTree(points, sizes, ids, ids)
    found = {tuple(sorted(map(int, p))) for p in N.tree_join(tree, tree, True)}
    linked = {(i, j) for j in ids for i in ids[:j]
              for both in [len(np.intersect1d(sets[i], sets[j]))] if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both)}
    assert linked and linked <= found and len(found) < len(linked) + 60


@pytest.mark.parametrize("seed,stars", [(1, 3), (2, 1)])
def test_all_pairs(spark, monkeypatch, seed, stars):
    monkeypatch.setattr(N, "TILE", 3)
    monkeypatch.setattr(N, "STARS", stars)
    docs = corpus(seed) + [(2001, None), (2002, ""), (2003, " \n"), (2004, "one two"), (2005, "ONE two"), (2006, "w " * 30000)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, class int, token string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.ngram_components(df).collect()}
    assert got == brute(docs)
    if stars == 1:
        kept = N.one_of_each(df)
        assert kept.columns == df.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, (_, c) in got.items() if d == c)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b c d e"), (1, "a b c d e")], "doc_id long, text string")
    assert [tuple(r) for r in N.ngram_components(df).collect()] == [(1, 2, 1)] * 2
    assert N.ngram_components(df.limit(0)).count() == 0
