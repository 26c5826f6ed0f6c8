"""T1 tagger and T2 sentence split against direct Python computations of the same rules."""
import hashlib
import re

from proflex.operators.segmentation import split_sentences
from proflex.operators.tagging import (CASE_BY_DIGIT, UPOS_BY_DIGIT, XPOS_BY_DIGIT, drop_empty, tag_text,
                                       tokenize)

SMOKE = "Juku joksis koolis. Aitüma."


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def py_tokens(text):
    toks = re.findall(r"\w+|[^\w\s]", text)
    out, sent, idx = [], 1, 0
    for t in toks:
        idx += 1
        out.append((sent, idx, t))
        if t in (".", "!", "?"):
            sent, idx = sent + 1, 0
    return out


def test_smoke_sentence_tokens(spark):
    got = drop_empty(tokenize(docs(spark, [SMOKE]))).orderBy("sent_id", "idx").collect()
    assert [(r.sent_id, r.idx, r.word) for r in got] == py_tokens(SMOKE)
    assert [r.word for r in got] == ["Juku", "joksis", "koolis", ".", "Aitüma", "."]


def test_tags_follow_the_rule(spark):
    text = "Kass jookseb kiiresti, 12 korda! Väga ilus ja suurepärane-ootamatu päev."
    got = drop_empty(tag_text(docs(spark, [text]))).collect()
    for r in got:
        w = r.word
        if not re.search(r"\w", w):
            assert (r.upos, r.xpos, r.feats) == ("PUNCT", "Z", None)
            continue
        if re.fullmatch(r"[0-9]+", w):
            assert (r.upos, r.xpos, r.feats) == ("NUM", "N", "NumForm=Digit|NumType=Card")
            continue
        h = hashlib.md5(w.lower().encode()).hexdigest()
        d1, d2 = int(h[0], 16), int(h[1], 16)
        assert r.upos == UPOS_BY_DIGIT[d1] and r.xpos == XPOS_BY_DIGIT[d1]
        lw = w.lower()
        assert r.lemma == lw[:4] + ("_" if len(w) >= 11 else "") + lw[4:6]
        if r.xpos in ("S", "A", "P"):
            assert f"Case={CASE_BY_DIGIT[d2]}" in r.feats


def test_sentences(spark):
    texts = ["Üks. Kaks kolm!  Neli?\nViis", "...", "", "Ilma lõputa", "Nii... 3.14 ok", None, " \u00a0", "A?! B.\u00a0C. "]
    got = {}
    for r in split_sentences(docs(spark, texts)).orderBy("doc_id", "sent_id").collect():
        got.setdefault(r.doc_id, []).append(r.sentence)
    assert got == {0: ["Üks.", "Kaks kolm!", "Neli?", "Viis"], 1: ["..."], 2: [""], 3: ["Ilma lõputa"], 4: ["Nii...", "3.14 ok"],
                   5: [""], 6: [""], 7: ["A?!", "B.", "C."]}


def test_pieces_without_tokens_keep_a_row(spark):
    got = tokenize(docs(spark, ["", "a. "])).collect()
    assert {(r.doc_id, r.sent_id, r.word) for r in got} == {(0, 1, None), (1, 1, "a"), (1, 1, "."), (1, 2, None)}
