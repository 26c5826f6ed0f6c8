"""Operator 2 against the definition worked through with Python integers."""
import hashlib
import random

import numpy as np
import pytest

from proflex.llm import order_minhash as O

BITS = (1 << 64) - 1


def brute(text):
    if not text:
        return [0] * O.SLOTS

    def kmer(part):
        level, step = [ord(c) + 1 for c in part], 1
        while step < O.K and len(level) > step:
            factor = O.mix_int(O.ODD * step & BITS) | 1
            level = [(a * factor + O.mix_int(b)) & BITS for a, b in zip(level, level[step:])]
            step *= 2
        return O.mix_int(level[0] if step >= O.K else (level[0] + step) & BITS)

    parts = [text[i:i + O.K] for i in range(len(text) - O.K + 1)] or [text]
    hashes, seen, drawn = [kmer(p) for p in parts], {}, []
    for part, h in zip(parts, hashes):
        seen[part] = seen.get(part, -1) + 1
        drawn.append((O.mix_int((h + seen[part] * O.ODD) & BITS) if seen[part] else h) >> 32)
    out = []
    for i, seed in enumerate(O.SEEDS):
        smallest = sorted(range(len(parts)), key=lambda p: (drawn[p] * seed & 0xFFFFFFFF, hashes[p] >> 20, p))[:O.TUPLE]
        total = (i + 1) * O.ODD & BITS
        chosen = sorted(smallest)
        for j in range(O.TUPLE):
            total = O.mix_int((total + hashes[chosen[min(j, len(chosen) - 1)]]) & BITS)
        out.append(total >> 48)
    return out


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_equals_definition(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(O, "CHUNK", 37)
    for text in ["", "a", "abcdefg", "abcdefgh", "abcdefghi", "aaaaaaaaaaaaaaaaaaaaaaaaa", "abab" * 40, *[words(rng, 30) for _ in range(15)]]:
        assert O.fingerprint(text).tolist() == brute(text), text


def test_long_text_path(monkeypatch):
    text = words(random.Random(8), 400) * 2
    want = O.fingerprint(text)
    monkeypatch.setattr(O, "POSITION_BITS", 20)
    hashes = O.kmers(text)
    packed = O.items(hashes)
    monkeypatch.setattr(O, "POSITION_BITS", 9)      # too few bits for the packed keys: the general sort
    general = O.items(hashes)
    assert np.array_equal(np.sort(packed[0]), np.sort(general[0])) and len(want) == O.SLOTS


def test_order_and_edits_matter():
    rng = random.Random(6)
    text = words(rng, 400)
    half = len(text) // 2
    own = O.fingerprint(text)
    near = O.likeness(own, O.fingerprint(text[:50] + "x" + text[51:]))
    moved = O.likeness(own, O.fingerprint(text[half:] + " " + text[:half]))
    other = O.likeness(own, O.fingerprint(words(rng, 400)))
    assert near > 0.85 and other < 0.05 and other < moved < 0.75


@pytest.mark.parametrize("partitions", [1, 7])
def test_edits_of_a_table(spark, partitions):
    rng = random.Random(11)
    rows = [(i * 3, words(rng, rng.randint(0, 40)), "s") for i in range(60)] + [(9, None, "t"), (None, "last one here", "u")]
    rows += [(200, "same text twice", "v"), (200, "same text twice", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = O.fingerprint_edits(df).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    ids = sorted({r[0] for r in rows if r[0] is not None}, reverse=True) + [None]
    texts = {r[0]: r[1] or "" for r in rows}
    for i, here in enumerate(ids):
        if here in (9, 200) or ids[(i + 1) % len(ids)] == 9:
            continue
        after = texts[ids[(i + 1) % len(ids)]]
        r, changed = by[here][0], O.edited(texts[here], after)
        own = O.fingerprint(texts[here])
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.n_chars == len(texts[here]) and r.fingerprint == O.printed(own)
        assert r.near_edited == O.likeness(own, O.fingerprint(changed)) and r.near_next == O.likeness(own, O.fingerprint(after))
    assert by[200][0].fingerprint == by[200][1].fingerprint and max(r.near_next for r in by[200]) == 1.0


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "abcd")], "doc_id long, text string")
    r = O.fingerprint_edits(df).collect()[0]
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert O.fingerprint_edits(df.limit(0)).count() == 0 and O.fingerprint_documents(df).count() == 1
