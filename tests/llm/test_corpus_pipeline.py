"""The pipeline on a small corpus whose outcome is known."""
import hashlib
import random

import corpus_pipeline as C
from proflex.llm.queries import multi_50k, split_pattern
from proflex.llm.bpe import ByteBPE


def test_run(spark, tmp_path):
    source = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en' and n_chars > 600").limit(12).collect()]
    rng = random.Random(1)
    prose = ["\n".join(line for line in t.split("\n") if len(line) > 60)[:900].rsplit(" ", 1)[0] + f" closing words {i}" for i, t in enumerate(source)]
    item = "Thnd edre onatha whened ingly theron eash onbleou thatre and. Wherre thinly ounden hanatre blees ondti with shouing erentha."
    edited = prose[0].split(" ")
    edited[5] = "changed"
    docs = [(i, p) for i, p in enumerate(prose)]
    docs += [(50, prose[1]), (51, prose[2].replace(" ", "  ")), (52, " ".join(edited)), (53, prose[3] + "\n" + item), (54, ""), (55, None),
             (56, "".join(rng.choice("qxzjkvw") for _ in range(600))), (57, "## 123 ##")]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in C.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(12))
    import public_tokenizers
    codec = ByteBPE(multi_50k(), public_tokenizers.PATTERN)
    assert split_pattern() == public_tokenizers.PATTERN
    for i in (4, 5):
        assert out[i].decoded_sha256 == hashlib.sha256(prose[i].encode()).hexdigest()
        assert out[i].n_tokens * 4 == len(codec.encode(prose[i]))


def test_stages_keep_columns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in C.STAGES[:4]:
        assert stage(spark, docs, "/root/testdata/sf0.001").columns == docs.columns, name


def test_near_links_five_words_at_80(spark):
    """Two documents whose 5-grams have Jaccard 0.81 and whose 4-grams have less than 0.85."""
    words = [f"w{i}" for i in range(52)]
    edited = words[:20] + ["other"] + words[21:]
    grams = [{tuple(w[i:i + 5]) for i in range(48)} for w in (words, edited)]
    assert 0.8 <= len(grams[0] & grams[1]) / len(grams[0] | grams[1]) < 0.85
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 1) for i, w in enumerate((words, edited, words[::-1]))],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in C.near(spark, docs, "").collect()} == {0, 2}
