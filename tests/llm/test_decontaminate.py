"""Operator 1 against a search that scores every passage with every unit."""
import math
import random
from collections import Counter

import pytest

from proflex.llm import decontaminate as D


def fewest_edits(item, words):
    """The fewest words replaced, inserted or removed that make the item a run of `words`."""
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        last, row = row, [i]
        for j, w in enumerate(words, 1):
            row.append(min(last[j - 1] + (a != w), last[j] + 1, row[j - 1] + 1))
    return min(row)


def brute(docs, items, threshold, overlap):
    units = [(i, w[s:s + D.UNIT_WORDS]) for i, t in items for w in [D.words_of(t or "")] for s in range(0, len(w), D.UNIT_WORDS)]
    df = Counter(t for _, u in units for t in set(u))
    mean = sum(len(u) for _, u in units) / len(units)
    weights = []
    for item, u in units:
        w = {t: math.log(1 + (len(units) - df[t] + .5) / (df[t] + .5)) * f * (D.K1 + 1) / (f + D.K1 * (1 - D.B + D.B * len(u) / mean))
             for t, f in Counter(u).items()}
        weights.append((item, {t: x / sum(w.values()) for t, x in w.items()}))
    out = set()
    texts = dict(items)
    for doc, text in docs:
        words = D.words_of(text or "")
        for s in range(0, max(1, len(words)), D.UNIT_WORDS):
            held = set(words[s:s + 2 * D.UNIT_WORDS])
            for item, w in weights:
                if sum(x for t, x in w.items() if t in held) < threshold:
                    continue
                q, a = D.question_and_answer(texts[item])
                around = words[max(0, s - len(q) - len(a)):s + 2 * D.UNIT_WORDS + len(q) + len(a)]
                joined = {tuple(around[i:i + n]) for n in (1, 2, 3) for i in range(len(around))}
                in_q, in_a, in_both = [len(D.grams(p) & joined) / len(D.grams(p)) if D.grams(p) else 1.0 for p in (q, a, q + a)]
                if max(min(in_q, in_a), in_both) >= overlap or fewest_edits(q + a, around) <= (1 - D.ORDERED) * len(q + a) + 1e-9:
                    out.add((doc, item))
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = ["w" + str(i) for i in range(400)]
    def prose(k):
        return " ".join(rng.choice(vocabulary[:rng.choice([20, 400])]) + rng.choice(["", "", "", ",", "."]) for _ in range(k))
    items = [(i, prose(rng.randint(3, 100))) for i in range(25)] + [(25, "one"), (26, "same item text here."), (27, "same item text here.")]
    docs = []
    for d in range(n):
        text = prose(rng.randint(0, 500))
        if rng.random() < 0.5:
            words = rng.choice(items)[1].split()
            if rng.random() < 0.4:      # an edited leak
                words = [w if rng.random() < 0.9 else "edit" for w in words]
            at = rng.randint(0, len(text))
            text = text[:at] + " " + " ".join(words).upper() + " " + text[at:]
        docs.append((d, text))
    return docs, items


@pytest.mark.parametrize("shard_chars", [1 << 20, 900])
def test_all_passages(spark, shard_chars):
    docs, items = corpus(1)
    want = brute(docs, items, D.THRESHOLD, D.OVERLAP)
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, item_id string, score int")
    b = spark.createDataFrame([(*r, "y") for r in items] + [(90, None, "z"), (91, "", "z"), (92, "...", "z")],
                              "item_id long, text string, doc_id string")
    rows = D.find_leaks(d, b, shard_chars=shard_chars).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) > 15
    clean = D.drop_leaks(d, b, shard_chars=shard_chars)
    assert clean.columns == d.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_edges(spark):
    item = "What is the answer to this question? It is forty two of course."
    d = spark.createDataFrame([(1, None), (2, ""), (3, item), (3, item), (4, "filler " * 100000 + item), (5, "other words")],
                              "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted(r.doc_id for r in D.find_leaks(d, b).collect()) == [3, 3, 4]
    assert D.find_leaks(d, b.limit(0)).count() == 0 and D.find_leaks(d.limit(0), b).count() == 0
    assert D.drop_leaks(d, b.limit(0)).count() == 6
    with pytest.raises(ValueError):
        D.find_leaks(d, b, shard_chars=5)


def test_edited_words_keep_items_found(spark):
    """Items with short answers of which one to three words were replaced, at a fixed recall."""
    rng = random.Random(6)
    vocabulary = ["v" + str(i) for i in range(3000)]

    def words(k):
        return [rng.choice(vocabulary) for _ in range(k)]
    items = [(i, " ".join(words(rng.randint(16, 45))) + "? " + " ".join(words(rng.randint(1, 4))) + ".") for i in range(60)]
    docs, planted = [], set()
    for item, text in items:
        for n in (0, 1, 2, 3):
            copy = text.split()
            for at in rng.sample(range(len(copy)), n - 1) + [len(copy) - 1] if n else []:     # the answer is hit each time
                copy[at] = "edited"
            docs.append((len(docs), " ".join(words(100) + copy + words(100))))
            planted.add((docs[-1][0], item))
    docs += [(1000 + i, " ".join(words(300) + rng.choice(items)[1].split()[:8])) for i in range(60)]
    b = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in D.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert found <= planted and len(found) >= 0.98 * len(planted)


def test_edits():
    import numpy as np
    rng = random.Random(7)
    for _ in range(200):
        item, words = ([rng.randrange(4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        assert D.edits(item, np.array(words)) == fewest_edits(item, words)


def test_shards_take_all_items_that_fit(spark):
    """200 items of up to 589 characters in shards of 800."""
    rng = random.Random(8)
    items = [(i, " ".join(f"u{rng.randrange(900)}" for _ in range(rng.randint(5, 117)))[:589]) for i in range(200)]
    source = spark.createDataFrame(items, "entry long, text string")
    shards = [s.collect() for s in D.shards_of(source, 800)]
    assert sorted(r.entry for s in shards for r in s) == list(range(200))
    assert max(sum(len(r.text) for r in s) for s in shards) <= 800
    with pytest.raises(ValueError, match="longer than a shard"):
        D.shards_of(source, 500)
