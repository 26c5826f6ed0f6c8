"""T1 learnt tagger and T10 context speller on small corpora with known answers."""
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from proflex.operators import lexicon_tagger as lt
from proflex.operators import speller as sp
from proflex.operators.correction import dictionary_correct
from proflex.operators.tagging import drop_empty

PAST = "Mood=Ind|Number=Sing|Person=3|Tense=Past|VerbForm=Fin|Voice=Act"
INE = "Case=Ine|Number=Sing"
TAUGHT = [("Juku", "Juku", "PROPN", "S", "Case=Nom|Number=Sing"), ("maksis", "maksma", "VERB", "V", PAST), ("oksis", "oksma", "VERB", "V", PAST),
          ("laulis", "laulma", "VERB", "V", PAST), ("koolis", "kool", "NOUN", "S", INE), ("poolis", "pool", "NOUN", "S", INE),
          ("koolis", "koolis", "ADV", "D", None), ("koolis", "kool", "NOUN", "S", INE), (".", ".", "PUNCT", "Z", None), ("12", "12", "NUM", "N", "x")]
SCHEMA = "word string, lemma string, upos string, xpos string, feats string"


def test_learnt_tagger(spark):
    lexicon = lt.build_lexicon(spark.createDataFrame(TAUGHT, SCHEMA))
    assert {r.form: (r.lemma, r.upos) for r in lexicon.collect()}["koolis"] == ("kool", "NOUN")
    rules = {r.ending: r for r in lt.suffix_rules(lexicon).collect()}
    assert (rules["ksis"].cut, rules["ksis"].added, rules["ksis"].upos) == (2, "ma", "VERB")
    assert (rules["oolis"].cut, rules["oolis"].added, rules["oolis"].upos) == (2, "", "NOUN")
    docs = spark.createDataFrame([(1, "Juku joksis koolis. Volis 3 xyz!"), (2, None), (3, "")], "doc_id long, text string")
    tagged = lt.tag_with_lexicon(docs, lexicon, lt.suffix_rules(lexicon))
    assert tagged.columns == ["doc_id", "sent_id", "idx", "word", "lemma", "upos", "xpos", "feats"]
    rows = [tuple(r)[1:] for r in drop_empty(tagged).orderBy("doc_id", "sent_id", "idx").collect()]
    assert rows == [(1, 1, "Juku", "Juku", "PROPN", "S", "Case=Nom|Number=Sing"), (1, 2, "joksis", "joksma", "VERB", "V", PAST),
                    (1, 3, "koolis", "kool", "NOUN", "S", INE), (1, 4, ".", ".", "PUNCT", "Z", None),
                    (2, 1, "Volis", "vol", "NOUN", "S", INE), (2, 2, "3", "3", "NUM", "N", "NumForm=Digit|NumType=Card"),
                    (2, 3, "xyz", "xyz", "NOUN", "S", None), (2, 4, "!", "!", "PUNCT", "Z", None)]
    assert tagged.where("doc_id > 1").count() == 2       # documents without tokens stay


def model(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, sentence string")
    words = df.selectExpr("explode(split(sentence, ' ')) AS word")
    return df, sp.candidates(sp.word_counts(words)), sp.ngram_counts(df)


def spelt(spark, texts, extra):
    df, pairs, grams = model(spark, texts + extra)
    empty = spark.createDataFrame([("zzz", "zzz")], "wrong string, right string")
    out = dictionary_correct(df, ["id"], "sentence", correction_list=empty, speller=(pairs, grams))
    return [r.spell_target for r in out.orderBy("id").collect()][len(texts):]


def test_ngrams_are_counted_from_rows(spark):
    """Every run of one to ORDER words, from null, blank and short sentences too; no function on arrays makes them."""
    texts = ["a b a b", "A", "", " ", None, "?!", "b, c.", "a b a b"]
    found = sp.ngram_counts(spark.createDataFrame([(t,) for t in texts], "sentence string"))
    expected = Counter()
    for t in texts:
        if t is not None:
            seq = [sp.START] * (sp.ORDER - 1) + re.findall(r"[a-z]+", t.lower()) + [sp.END]
            expected.update((n, " ".join(seq[i:i + n])) for n in range(1, sp.ORDER + 1) for i in range(len(seq) - n + 1))
    assert {(r.words, r.gram): r.times for r in found.collect()} == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_join" not in plan and "slice(" not in plan


def test_context_decides(spark):
    texts = ["the big cat sat"] * 300 + ["a red car ran"] * 300
    # `caz` is as near to `cat` as to `car`; its neighbours tell which; alone, the smaller is taken, and a capital stays
    assert spelt(spark, texts, ["the big caz sat", "a red caz ran", "Caz"]) == ["the big cat sat", "a red car ran", "Car"]
    # the same corpus ten times: a misspelling seen ten times is still one (no absolute counts)
    assert spelt(spark, texts * 10, ["the big caz sat"] * 10 + ["a red Carr ran"]) == ["the big cat sat"] * 10 + ["a red Car ran"]


def test_neighbours_are_decided_together():
    rng = random.Random(4)
    vocabulary = ["aa", "ab", "ba", "bb"]
    times = {"aa": 50, "ab": 40, "ba": 60, "bb": 30}
    for n in (2, 3):
        for _ in range(40):
            times[" ".join(rng.choice(vocabulary) for _ in range(n))] = rng.randint(1, 20)
    for gram in [g for g in times if g.count(" ") == 2]:      # prefixes are at least as frequent
        a, b, c = gram.split()
        times[f"{a} {b}"] = max(times.get(f"{a} {b}", 0), times[gram])
    for _ in range(50):
        toks = [rng.choice(vocabulary) for _ in range(7)]
        hits = [{"pos": i, "rights": rng.sample([v for v in vocabulary if v != t], 2)} for i, t in enumerate(toks) if rng.random() < 0.5]
        s = sp.SentenceWords(toks, toks, hits, [])
        s.own.clear()
        got = dict(s.choose(times, 180))
        from itertools import product
        best = None
        for choice in product(*s.options):
            loss, changes = 0, 0
            for j in range(2, len(choice)):
                a, b, c = choice[j - 2:j + 1]
                t3, t2 = times.get(f"{a} {b} {c}", 0), times.get(f"{b} {c}", 0)
                loss -= (sp.micro_log(t3) - sp.micro_log(times[f"{a} {b}"]) if t3 else sp.BACKOFF + sp.micro_log(t2) - sp.micro_log(times[b]) if t2
                         else 2 * sp.BACKOFF + sp.micro_log(max(times.get(c, 0), 1)) - sp.micro_log(180))
                if c != s.options[j][0]:
                    loss, changes = loss + sp.CHANGE, changes + 1
            best = min(best or (loss, changes, choice), (loss, changes, choice))
        want = {s.at[j]: w for j, w in enumerate(best[2]) if w != s.options[j][0]}
        assert got == want


def test_hashed_ngrams_are_the_counted_ones(spark):
    texts = ["a b a b", "A", "", None, "?! õ", "b, c.", "a b a b"]
    sentences = spark.createDataFrame([(t,) for t in texts], "sentence string")
    named = sp.ngram_counts(sentences).select("words", *sp.gram_key(), "times")
    hashed = sp.ngram_counts(sentences, hashed=True).select(*named.columns)
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, hashed.collect()))


def test_words_without_a_partner_do_not_travel(spark):
    """The map of the dictionary words stands before the join, holds them all and few others, and is bounded."""
    from proflex.operators.lookups import MAP_FIELDS, word_map
    listed = spark.range(5000).selectExpr("concat('w', id) AS tok", "'x' AS new")
    may_hold = word_map(listed, "tok")
    assert listed.where(may_hold(F.col("tok"))).count() == 5000
    assert spark.range(20_000).selectExpr("concat('v', id) AS tok").where(may_hold(F.col("tok"))).count() < 2000
    assert not spark.range(9).selectExpr("concat('v', id) AS tok").where(word_map(listed.limit(0), "tok")(F.col("tok"))).count()
    assert MAP_FIELDS * 8 <= 8 << 20
    sentences = spark.createDataFrame([(1, "w1 v2 w3"), (2, ""), (None, "w4")], "id long, sentence string")
    got = dictionary_correct(sentences, ["id"], "sentence", correction_list=listed.selectExpr("tok AS wrong", "new AS right"))
    assert {r.id: r.spell_target for r in got.collect()} == {1: "x v2 x", 2: "", None: "w4"}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "scalar-subquery" in plan[:plan.index("Generate")]


def test_ngram_counts_of_the_corpus_are_not_stored(spark, tmp_path):
    """They are several times as large as the corpus; the chain counts them where they meet what is asked for."""
    from proflex.plans import corpus
    rows = [(i, "the big cat sat. " * 30 + ("The caz sat." if i == 3 else ""), "s1") for i in range(6)] + [(6, None, "s1")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    counts = corpus.form_counts(spark, str(tmp_path))
    pairs, grams = corpus.speller_model(spark, str(tmp_path), counts)
    assert "Scan parquet" in grams._jdf.queryExecution().executedPlan().toString()
    empty = spark.createDataFrame([("zzz", "zzz")], "wrong string, right string")
    fixed = dictionary_correct(corpus.sentences(spark, str(tmp_path)), ["doc_id", "sent_id"], "sentence", correction_list=empty, speller=(pairs, grams))
    changed = fixed.where("spell_target <> sentence").collect()
    assert [(r.doc_id, r.sentence, r.spell_target) for r in changed] == [(3, "The caz sat.", "The cat sat.")]
