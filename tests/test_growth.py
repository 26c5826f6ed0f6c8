"""Queries whose time or shuffled bytes must not grow faster than the input."""
import hashlib
import time

import pytest
from pyspark.sql import functions as F

from proflex.operators import tagging
from proflex.operators.tagging import tag_text


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tags_are_those_of_the_rule_and_computed_once(spark):
    words = ["Maja", "on", "suur", "ja", "ilus", "läksime", "kooli", "minu", "et", "pärast", "12", ".", "raamatukogudes"] + [f"sõna{i}" for i in range(400)]
    tags = tag_text(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"))
    rows = tags.collect()
    assert len(rows) > 400
    for r in rows:
        d1, d2, d3 = (int(c, 16) for c in hashlib.md5(r.word.lower().encode()).hexdigest()[:3])
        if r.word in (".", "12"):
            assert (r.upos, r.xpos, r.feats) == (("PUNCT", "Z", None) if r.word == "." else ("NUM", "N", tagging.NUMERAL_FEATS))
            continue
        assert (r.upos, r.xpos) == (tagging.UPOS_BY_DIGIT[d1], tagging.XPOS_BY_DIGIT[d1])
        if r.xpos in "SAP":
            assert r.feats.startswith(("Abbr=Yes|" if d2 == 15 else "") + f"Case={tagging.CASE_BY_DIGIT[d2]}|")
        assert (r.feats is None) == (r.xpos in "DJI")
    # a filter on the tags does not write the hash out again
    assert plan(tags.where("xpos <> 'Z' AND feats IS NOT NULL").groupBy("feats").count()).count("md5") == 1


def test_correction_lines_do_not_carry_their_document(spark, tmp_path):
    from proflex.plans.registry import QUERIES
    words = [f"w{i}" for i in range(40_000)]
    rows = [(1, "head;er a  b", "s1"), (2, " ".join(["head", *words]), "s1"), (3, None, "s1"), (4, "", "s2")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    began = time.time()
    got = {r.wrong: r.right for r in QUERIES["s10_correction_list"](spark, str(tmp_path)).collect()}
    assert time.time() - began < 60      # the array of the words with each word: 40,000 x 40,000
    assert got == {"a": "", "": "b"} | {a: b for a, b in zip(words, words[1:])}


def test_tail_is_found_once_for_a_document(spark):
    from proflex.operators import segmentation as seg
    text = "".join(f"Lause number {i}. " for i in range(20_000)) + "Lõpp.\n\n"
    d = spark.createDataFrame([(1, text), (2, None), (3, " \n")], "doc_id long, text string")
    began = time.time()
    back = seg.reassemble(seg.delimiters(d), ["doc_id"], "sent_id", "sentence", "delim", "tail")
    assert {r.doc_id: r.text for r in back.collect()} == {1: text, 2: "", 3: " \n"}
    assert time.time() - began < 30      # searching the text for each sentence: 20,000 x 400,000 characters


def test_documents_move_once_for_their_features(spark, tmp_path):
    from proflex.plans.corpus import document_features
    rows = [(i % 40, " ".join(f"sõna{i * j % 97}" for j in range(200)) + ".", f"s{i % 40}") for i in range(45)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    f = document_features(spark, str(tmp_path), ["lemma_count", "MTLD", "rare_5000"], with_lookups=False).dropna(subset=["MTLD"])
    # tokens and collected sets stay where the document was dealt; the fold of MTLD is planned once
    physical = f._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1
    assert plan(f).count("aggregate(filter(sort_array(zip_with") == 1
    assert f.count() == 40


def test_lexicon_by_lemma_is_the_lookup_of_each_token(spark):
    from proflex.operators.features import LEXICON_AGGREGATES, feature_table, prepare_tokens
    from proflex.operators.lookups import build_lexicon
    docs = [(1, "a", "kass koer kass maja puu kivi kivi."), (1, "a", "kass laud"), (None, None, "kass koer 12 ."), (2, None, ""), (3, "b", None)]
    toks = tag_text(spark.createDataFrame(docs, "doc_id long, part string, text string"), carry=("part",))
    lexicon = build_lexicon(toks)
    names = ["word_count", "S_abstr", "rare_5000", "rare_1000"]
    keys = ["doc_id", "part"]
    by_token = feature_table(prepare_tokens(toks, lexicon=lexicon), keys, names).collect()
    by_lemma = feature_table(prepare_tokens(toks), keys, names, lexicon=lexicon).collect()
    assert len(by_lemma) == 4 and LEXICON_AGGREGATES
    assert sorted(map(str, by_token)) == sorted(map(str, by_lemma))


def test_mtld_fold_carries_three_numbers(spark):
    """Sorting and folding structs took half of the time of the model features."""
    from proflex.operators.features import mtld_fold
    lists = spark.createDataFrame([(1, ["a"] * 4), (2, None), (3, [f"w{i}" for i in range(5)] * 2), (4, [])], "i int, words array<string>")
    found = lists.select("i", mtld_fold(F.col("words")).alias("m"))
    # places are numbers, and the ratio stands in the condition of a step only
    assert "shiftleft" in plan(found) and "ttr" not in plan(found)
    assert {r.i: r.m for r in found.collect()} == {1: 2.0, 2: None, 3: 10.0, 4: -1.0}


def test_tail_is_searched_only_where_a_text_ends_in_one(spark):
    from proflex.operators import segmentation as seg
    texts = ["A. B.", "A. B. ", "A. B.\n", "A.\u2003B \u3000", "", " \n", None, "A.\r\n", "x y", "õ.\x85", "A.  \U0001f600", "\tA."]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = seg.delimiters(d)
    assert plan(rows).count("substring(") >= 2
    got = {}
    for r in rows.orderBy("doc_id", "sent_id").collect():
        got.setdefault(r.doc_id, []).append((r.delim, r.sentence, r.tail))
    for i, text in enumerate(texts):
        whole = text or ""
        tail = whole[len(whole.rstrip()):] if whole.strip() else whole
        assert {t for _, _, t in got[i]} == {tail}
        assert "".join(a + b for a, b, _ in got[i]) + tail == whole
    assert [b for _, b, _ in got[1]] == ["A.", "B."] and [b for _, b, _ in got[6]] == [""]
