"""Operator 7 against all splits of a text and against the public tokenizer library."""
import functools
import random
import tracemalloc

import pytest

from proflex.llm import queries, unigram


def brute(scores, unknown, word):
    """Best (score, -tokens) over all splits."""
    @functools.cache
    def best(i):
        if i == 0:
            return (0, 0)
        options = []
        for j in range(i):
            if word[j:i] in scores:
                s, t = best(j)
                options.append((s + scores[word[j:i]], t - 1))
        if word[i - 1] not in scores:
            s, t = best(i - 1)
            options.append((s + unknown, t - len(word[i - 1].encode())))
        return max(options)
    return -best(len(word))[1]


def test_all_splits():
    rng = random.Random(1)
    for _ in range(30):
        pieces = sorted({"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 4))) for _ in range(15)})
        scores = {p: -rng.randint(1, 6) for p in pieces}
        counter = unigram.TrieCounter(scores, max_nodes=40)
        words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 9))) for _ in range(40)]
        expected = sum(brute(scores, counter.unknown, "▁" + w) for w in words)
        assert counter.count("  ".join(words)) == (40, expected)


def test_long_pretokens(monkeypatch):
    """Below the trie the counts are those of a trie without end, and memory is bounded."""
    rng = random.Random(4)
    pieces = sorted({"".join(rng.choice("▁abc") for _ in range(rng.randint(1, 6))) for _ in range(40)})
    scores = {p: -rng.randint(1, 9) for p in pieces}
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(1, 60))) for _ in range(200)]
    whole = [unigram.TrieCounter(scores).count(w) for w in words]
    for shared in (1, 5, 6, 30):
        monkeypatch.setattr(unigram, "SHARED", shared)
        counter = unigram.TrieCounter(scores, max_nodes=60)
        assert [counter.count(w) for w in words] == whole
        assert counter.count(" ".join(words)) == (len(words), sum(t for _, t in whole))
    monkeypatch.undo()
    counter = unigram.TrieCounter(scores)
    tracemalloc.start()
    assert counter.count("ab" * 150_000)[0] == 1 and counter.nodes <= unigram.SHARED + 1
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


def test_library_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    scores = queries.unigram_scores()
    counter = unigram.TrieCounter(scores)
    vocab = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", -1e3) for b in range(256)] + [(p, s / 1e6) for p, s in scores.items()]
    model = tokenizers.Tokenizer(tokenizers.models.Unigram(vocab, 0, True))
    for text in ("the information of theirs", "ciónñarie über naïve", "internationalisation", "日本語", "x7f9aQ"):
        assert counter.count(text)[1] == sum(len(model.encode("▁" + w).ids) for w in text.split()), text


def test_table_cases(spark):
    df = spark.createDataFrame([(1, None, 1), (2, " \n\t", 2), (3, "the cat", 3), (3, "the cat", 3), (4, "ab " * 50000, 4)],
                               "doc_id long, text string, n_tokens int")
    rows = unigram.count_tokens(df, queries.unigram_scores).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == 5 and by[1].n_tokens == by[2].n_tokens == 0 and by[1].chars_per_token is None
    assert by[4].n_pretokens == 50000 and by[4].n_tokens % 50000 == 0
    assert unigram.count_tokens(df.limit(0), queries.unigram_scores).count() == 0


def test_looks_up_no_longer_strings_than_entries_with_that_end():
    class Counted(dict):
        asked = 0

        def get(self, key, default=None):
            Counted.asked += 1
            return super().get(key, default)
    scores = {"▁" + "a" * 30: -1, "b": -3, "c": -4, "bc": -5, "▁": -2}
    counter = unigram.TrieCounter(Counted(scores))
    word = "bc" * 100
    assert counter.count(word) == (1, brute(scores, counter.unknown, "▁" + word))
    assert Counted.asked < 3 * len(word)      # 31 for each character before
