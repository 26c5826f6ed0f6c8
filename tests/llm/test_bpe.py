"""Operator 10 against the public tokenizer library and an exact round trip."""
import base64
import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from proflex.llm import bpe, queries  # noqa: E402

FILE = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(FILE, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rng = random.Random(7)
    alphabets = ["abc ", "aAéñ ß\n", "the in er on", "0123456789abcdef", "日本語 テスト😀", " \t\n\x1c\x85  ", "'strevmlld ",
                 "".join(map(chr, range(32, 127)))]
    out = ["", "a", "<|endoftext|>", "x" * 5000, " " * 3000, "ab" * 2000, "é" * 50]
    out += ["".join(rng.choice(a) for _ in range(rng.randint(1, 200))) for a in alphabets for _ in range(60)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(60)]
    return out


def test_equals_reference_and_round_trips(reference):
    codec = bpe.ByteBPE(FILE, P.PATTERN, memo_entries=50)
    import numpy as np
    for text in texts():
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(text), repr(text)
        assert codec.decode(ids) == text.encode()


def test_pieces_equal_merges():
    """The backtracking walk equals the merge procedure on pieces of random bytes."""
    codec = bpe.ByteBPE(FILE, P.PATTERN)
    rng = random.Random(3)
    for _ in range(400):
        data = bytes(rng.choice(b"aeinrst th\xc3\xa9\xf0") for _ in range(rng.randint(1, 30)))
        expected = [codec.ranks[data]] if data in codec.ranks else [codec.ranks[p] for p in codec.merged(data)]
        assert codec.encode_piece(data) == expected


def test_table_cases(spark):
    long = "the long text " * 20000
    df = spark.createDataFrame([(1, None, "x", 5), (2, "", "y", 6), (2, "", "y", 6), (3, long, None, 7), (None, "né", "z", 8)],
                               "doc_id long, text string, ids string, n_tokens int")
    rows = bpe.encode_documents(df, queries.multi_50k, P.PATTERN, with_ids=True).collect()
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted((r.doc_id or 0, r.n_tokens > 0) for r in rows) == [(0, True), (1, False), (2, False), (2, False), (3, True)]
    assert all(r.ids_sha256 == nothing for r in rows if r.doc_id in (1, 2))
    by = {r.doc_id: r for r in rows}
    assert bytes(by[3].decoded) == long.encode() and by[3].n_tokens == len(by[3].ids)
    assert bpe.encode_documents(df.limit(0), queries.multi_50k, P.PATTERN).count() == 0


def test_codec_outlives_a_task():
    """The automaton and what is known of pairs and pieces serve all tasks of a worker, and stay bounded."""
    codec = bpe.worker_codec(FILE, P.PATTERN)
    ids = codec.encode("one two threefour")
    again = bpe.worker_codec(FILE, P.PATTERN)
    assert again is codec and again.encoded and again.encode("one two threefour") == ids
    assert bpe.worker_codec.cache_info().maxsize == 1
