"""Library operators that the driver tables cannot exercise as queries."""
import json

from pyspark.sql import functions as F

from proflex.functions import text as fx
from proflex.operators.correction import add_response, batch_infer, chain, chain_max_positions, dictionary_correct
from proflex.operators.lookups import syllable_lookup
from proflex.operators.segmentation import delimiters, reassemble, sentence_offsets
from proflex.sources.files import encode_response


def test_meta_from_name_and_dir(spark):
    df = spark.createDataFrame(
        [("B1_2018IV_003-092.txt", "/x/Texts/Test2/B2_semiformal_letters/doc_1_item.txt"),
         ("C1_2017II_001-133.txt", "/x/Texts/Test2/A2/doc_2_item.txt")], "name string, path string")
    got = df.select(fx.level_from_name("name").alias("l"), fx.exam_from_name("name").alias("e"),
                    fx.level_from_dir("path").alias("dl"), fx.type_from_dir("path").alias("dt")).collect()
    assert (got[0].l, got[0].e, got[0].dl, got[0].dt) == ("B1", "2018IV", "B2", "semiformal letter")
    assert (got[1].l, got[1].e, got[1].dl, got[1].dt) == ("C1", "2017II", "A2", "description/narration")


def test_syllable_table_join_with_fallback(spark):
    toks = spark.createDataFrame([("koolis",), ("xyz",), ("aitäh",)], "word string")
    table = spark.createDataFrame([("koolis", "koo-lis")], "word string, syllabified string")
    got = {r.word: r.syllables for r in syllable_lookup(toks, table).collect()}
    assert got == {"koolis": 2, "xyz": 1, "aitäh": 2}


def test_offsets_and_reassembly_rebuild_text(spark):
    texts = ["Tere!  Kuidas läheb?\\nHästi. ", "Üks lause", "  Algus. Lõpp.", "", " \u00a0 ", "Nii... 3.14 ok"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    off = sentence_offsets(docs).collect()
    for r in off:
        assert texts[r.doc_id][r.start:r.start + len(r.sentence)] == r.sentence
    # T5: sentences, the white space before them and the tail give back the whole text
    got = {r.doc_id: r.text for r in reassemble(delimiters(docs), ["doc_id"], "sent_id", "sentence", "delim", "tail").collect()}
    assert got == dict(enumerate(texts))


def test_chain_and_response_json(spark):
    s = spark.createDataFrame([(1, 1, "Juku joksis koolis. Aitüma.")], "doc_id long, sent_id int, sentence string")
    cl1 = spark.createDataFrame([("joksis", "jooksis")], "wrong string, right string")
    cl2 = spark.createDataFrame([("Aitüma", "Aitäh")], "wrong string, right string")

    def step(cl):
        return lambda df: dictionary_correct(df, ["doc_id", "sent_id"], "sentence", correction_list=cl) \
            .select("doc_id", "sent_id", F.col("spell_target").alias("sentence"))

    out = chain(step(cl1), step(cl2))(s).first().sentence
    assert out == "Juku jooksis koolis. Aitäh."
    assert chain_max_positions([None, 200, 150]) == 150 and chain_max_positions([None]) is None
    both = dictionary_correct(s, ["doc_id", "sent_id"], "sentence", correction_list=cl1.unionByName(cl2))
    resp = encode_response(add_response(both, "sentence", "spell_target", "spell_pieces"), "response").first().json
    r = json.loads(resp)
    assert r["status_code"] == 200 and r["corrected_text"] == out
    # changes three unchanged tokens apart stay separate spans; single-space context dropped
    assert [c["span"]["value"] for c in r["corrections"]] == ["joksis", "Aitüma."]
    assert [c["replacements"][0]["value"] for c in r["corrections"]] == ["jooksis", "Aitäh."]
    gone = dictionary_correct(s, ["doc_id", "sent_id"], "sentence",
                              correction_list=spark.createDataFrame([("joksis", None)], "wrong string, right string"))
    text = encode_response(add_response(gone, "sentence", "spell_target", "spell_pieces"), "response").first().json
    assert json.loads(text)["corrections"][0]["replacements"] == [{"value": None}]


def test_batch_infer_restores_order(spark):
    s = spark.createDataFrame([(i, "sõna " * (i % 5 + 1)) for i in range(30)], "id long, sentence string")
    def model(batch):
        assert len(batch) <= 10 and sum(len(x.split()) for x in batch) <= 12 or len(batch) == 1
        return [x.upper() for x in batch]

    out = batch_infer(s.repartition(1), model, max_sentences=10, max_tokens=12)
    got = {r.id: r.target for r in out.collect()}
    assert all(got[i] == ("sõna " * (i % 5 + 1)).upper().strip() for i in range(30))


def test_tagger_plugin(spark):
    from proflex.operators.tagging import tag_with_pandas
    toks = spark.createDataFrame([(1, "Kass"), (2, ".")], "idx int, word string")

    def tagger(pdf):
        return pdf.assign(lemma=pdf.word.str.lower(), upos="X", xpos="X", feats=None)

    got = tag_with_pandas(toks, tagger).orderBy("idx").collect()
    assert [r.lemma for r in got] == ["kass", "."] and got[0].upos == "X"
