"""Operator 8: the fusion worked through in Python, and accuracy on held-out documents."""
import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from proflex.llm import langid as G
from proflex.session import table_path

LANGUAGES = ["de", "en", "fr"]


def brute(rows):
    """rows: (id, host, declared, scores, letters) -> id: (lang, posterior)"""
    names = LANGUAGES + [G.UND]
    picks = {}
    for i, _, _, scores, letters in rows:
        s = [*scores, 0.0]
        picks[i] = 3 if not letters else s.index(max(s))
    host = lambda h: h
    domain = lambda h: ".".join(h.split(".")[-2:])
    suffix = lambda h: h.split(".")[-1]
    tables = {k: defaultdict(Counter) for k in ("host", "domain", "suffix", "declared")}
    total = Counter()
    for i, h, d, _, _ in rows:
        for k, v in (("host", host(h)), ("domain", domain(h)), ("suffix", suffix(h)), ("declared", d)):
            tables[k][v][picks[i]] += 1
        total[picks[i]] += 1
    out = {}
    for i, h, d, scores, letters in rows:
        if not letters:
            out[i] = (G.UND, 1.0)
            continue
        own = Counter({picks[i]: 1})
        n = lambda c, l: c[l] - own[l]
        size = sum(n(total, l) for l in range(4))
        prior = [(n(total, l) + 1) / (size + 4) for l in range(4)]
        for k, v in (("domain", domain(h)), ("host", host(h))):
            c = tables[k][v]
            m = sum(n(c, l) for l in range(4))
            prior = [(n(c, l) + G.STRENGTH * prior[l]) / (m + G.STRENGTH) for l in range(4)]
        prior[3] = G.UND_PRIOR
        score = []
        for l in range(4):
            s = [*scores, 0.0][l] + math.log(prior[l])
            for k, v in (("suffix", suffix(h)), ("declared", d)):
                s += math.log((n(tables[k][v], l) + 1) / (n(total, l) + len(tables[k])))
            score.append(s)
        best = max(score)
        out[i] = (names[score.index(best)], 1 / sum(math.exp(s - best) for s in score))
    return out


def test_fusion(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        true = rng.randrange(3)
        scores = [round(rng.gauss(3 if l == true else 0, 2), 6) for l in range(3)]
        host = rng.choice(["a.x.com", "b.x.com", "x.com", "y.de", "", "z.org"] if true else ["deep.y.de", "y.de"])
        rows.append((i, host, rng.choice([LANGUAGES[true], LANGUAGES[true], "", "en"]), scores, rng.choice([0, 9, 9, 9, 9])))
    df = spark.createDataFrame(rows, "id long, host string, declared string, scores array<double>, letters long")
    df = df.withColumn("domain", G.domain_of(F.col("host"))).withColumn("suffix", G.suffix_of(F.col("host")))
    want = brute(rows)
    got = {r.id: (r.lang, r.posterior) for r in G.identify(df, LANGUAGES).collect()}
    assert set(got) == set(want)
    for i in want:
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6, i


def test_trigrams():
    assert len(G.letter_trigrams("")) == 0 == len(G.letter_trigrams("12 3."))
    assert len(G.letter_trigrams("abc")) == 3
    assert G.letter_trigrams("Ab, cd").tolist() == G.letter_trigrams(" ab  CD!").tolist()
    assert G.visible("<p>a<script>x</script><!-- y -->b") .split() == ["a", "b"]


def test_held_out_and_pages(spark):
    docs = spark.read.parquet(table_path("/root/testdata/sf0.001", "documents"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    model = G.fit(docs.where(~held), sample=60)
    test = docs.where(held)
    found = G.identify_documents(test.drop("lang").withColumn("lang", F.lit(None).cast("string")), model)
    right = found.join(test.select("doc_id", F.col("lang").alias("true")), "doc_id").select(F.avg((F.col("lang") == F.col("true")).cast("int"))).first()[0]
    assert right > 0.97
    rng = random.Random(1)
    extra = [(900000, ""), (900001, None), (900002, "%%% 123 ###"), (900003, "".join(rng.choice("qxzjkvwypbg") for _ in range(400))),
             (900004, " ".join("".join(rng.choice("qxzjkvwypbg") for _ in range(9)) for _ in range(50)))]
    junk = spark.createDataFrame([(i, t, "en", "src0", 0) for i, t in extra], docs.schema)
    with_host = docs.unionByName(junk).withColumn("host", F.lit("clash")).withColumn("_x", F.lit(1))
    kept = G.keep_identified(with_host)
    assert kept.columns == with_host.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    pages = spark.createDataFrame([(1, "http://a.x.com/p", "<html lang='en-GB'><p>The answer of the thing in the other"), (2, None, None), (3, "odd", ""),
                                   (3, "odd", "")], "page_id long, url string, html string")
    rows = {r.page_id: r for r in G.identify_pages(pages, model).collect()}
    assert rows[1].lang == "en" and rows[2].lang == rows[3].lang == G.UND
    assert G.identify_pages(pages.limit(0), model).count() == 0
