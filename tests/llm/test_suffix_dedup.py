"""Operator 5: suffix arrays against sorted suffixes, and removal against all windows."""
import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from proflex.llm import suffix_dedup as S


def test_suffix_arrays():
    rng = random.Random(1)
    cases = [[], [3], [1] * 50, [1, 2] * 30, [2, 1] * 30, list(range(40)), list(range(40, 0, -1)), [0, 0, 1, 0, 0, 1, 0]]
    cases += [[rng.randrange(k) for _ in range(rng.randint(1, 80))] for k in (2, 3, 5, 30) for _ in range(150)]
    for s in cases:
        assert S.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:]), s


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + S.SPAN] for d in data for i in range(len(d) - S.SPAN + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - S.SPAN + 1):
            if seen[d[i:i + S.SPAN]] > 1:
                gone[i:i + S.SPAN] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß日") for _ in range(rng.randint(1, 9))) for _ in range(300)]

    def prose(n):
        return " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.randint(60, 200)) for _ in range(4)]
    texts = []
    for _ in range(60):
        kind = rng.random()
        if kind < 0.6:
            t = rng.choice(base).split()
            for _ in range(rng.randint(0, 4)):
                t[rng.randrange(len(t))] = rng.choice(words)
            t = " ".join(t)[rng.randint(0, 50):]
        elif kind < 0.8:
            t = prose(40) + rng.choice(base)[100:100 + rng.randint(150, 420)] + prose(30)
        else:
            t = prose(rng.randint(0, 100))
        texts.append(t)
    texts += ["", None, "x" * 199, "x" * 200, "y" * 900, "ab" * 400, base[0][:300] * 3, "same " * 60, "same " * 60]
    return texts


def test_anchors_serve_each_window_once(monkeypatch):
    for piece in (S.PIECE, 150, 1):
        monkeypatch.setattr(S, "PIECE", piece)
        of_window = {}
        for text in corpus(3)[:20]:
            data = S.text_bytes(text)
            hashes, _, first, count, offset = S.anchors(data)
            assert np.concatenate([np.arange(f, f + c) for f, c in zip(first, count)]).tolist() == list(range(len(data) - S.SPAN + 1))
            for h, f, c, o in zip(hashes, first, count, offset):
                for w in range(f, f + c):
                    assert 0 <= f + o - w <= S.SPAN - S.GRAM
                    key = data[w:w + S.SPAN].tobytes()
                    assert of_window.setdefault(key, (h, f + o - w)) == (h, f + o - w)


@pytest.mark.parametrize("seed,wide", [(1, S.WIDE), (2, 3)])
def test_all_windows(spark, monkeypatch, seed, wide):
    monkeypatch.setattr(S, "WIDE", wide)
    texts = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in enumerate(texts)], "doc_id long, text string, hash int, anchor string")
    got = {r.doc_id: tuple(r)[1:5] for r in S.remove_repeats(df).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want and sum(w[1] > 0 for w in want) > 20


def test_groups_of_contexts():
    rng = random.Random(4)
    S_before, S.SPAN = S.SPAN, 12
    try:
        for _ in range(300):
            core = bytes(rng.choice(b"ab") for _ in range(6))
            contexts = list({(bytes(rng.choice(b"ab\0") for _ in range(left)) + core + bytes(rng.choice(b"ab\0") for _ in range(rng.randint(6, 14))), left)
                             for _ in range(8) for left in [rng.randint(0, 10)]})
            want = [[p for p in range(len(d) - 11) if p <= at and p + 12 >= at + 6 and any(
                j != i and d2[max(0, at2 - at + p):at2 - at + p + 12] == d[p:p + 12] and at2 - at + p >= 0 for j, (d2, at2) in enumerate(contexts))]
                for i, (d, at) in enumerate(contexts)]
            got = S.repeated_windows(contexts)
            for g, w, (d, at) in zip(got, want, contexts):
                assert set(w) <= set(g), (contexts, g, w)
                for p in g:
                    assert sum(d[p:p + 12] == d2[q:q + 12] for d2, _ in contexts for q in range(len(d2) - 11)) > 1
    finally:
        S.SPAN = S_before


def test_small_tables(spark):
    df = spark.createDataFrame([(1, "z" * 250), (1, "z" * 250), (None, "w" * 50)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in S.remove_repeats(df).collect())
    assert got == [(0, 0, 0), (1, 250, 1), (1, 250, 1)]
    assert S.remove_repeats(df.limit(0)).count() == 0
