"""T3-T5 on whole texts, T9 and P8, and the lists of S10 and S11 in many files."""
from pyspark.sql import functions as F

from proflex.operators.correction import apply_corrections
from proflex.operators.requests import delimiters_of, piece_array, piece_delimiters, process_requests
from proflex.operators.segmentation import reassemble
from proflex.sources.files import read_correction_list, read_truecase_list

TEXTS = [(1, "  One two three.\n\nFour!  Five six seven eight nine? "), (2, None), (3, " \n\t"), (4, "x" * 25), (5, "a b. " * 40), (6, "No end")]


def test_pieces_give_the_text_back(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    found = piece_delimiters(docs, piece_array(F.col("text"), 10))
    assert found.where("length(piece) > 10").count() == 0
    rows = {r.doc_id: r.text for r in reassemble(found.where("piece = trim(piece)"), ["doc_id"], "piece_no", "piece", "delim", "tail").collect()}
    whole = {}
    for r in found.orderBy("doc_id", "piece_no").collect():
        whole[r.doc_id] = whole.get(r.doc_id, "") + r.delim + r.piece
    tails = {r.doc_id: r.tail for r in found.collect()}
    assert {d: whole[d] + tails[d] for d in whole} == {d: t or "" for d, t in TEXTS}
    assert rows[4] == "x" * 25 and rows[6] == "No end"


def test_pieces_that_are_not_found():
    assert delimiters_of("a  b c", ["a", "b", "c"]) == ["", "  ", " ", ""]
    assert delimiters_of("a  b c", ["a", "x", "c"]) == ["", " ", " ", ""]
    assert delimiters_of(" a", ["a"]) == [" ", ""]


def test_requests(spark):
    texts = [(1, "  The cat sat.\n\nIt saw a dgo and teh cat!  "), (2, "teh"), (3, None), (4, "teh " * 10), (5, "no change here.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("sentence", F.lit("x"))
    entries = spark.createDataFrame([("dgo", "dog"), ("teh", "the"), ("sat", "")], "wrong string, right string")
    responses, rejected = process_requests(docs, max_chars=39 + 10, correction_list=entries)
    assert rejected.count() == 0
    responses, rejected = process_requests(docs, max_chars=39, correction_list=entries)
    assert [(r.doc_id, r.chars, r.status_code) for r in rejected.orderBy("doc_id").collect()] == [(1, 43, 422), (4, 40, 422)]
    responses, _ = process_requests(docs, correction_list=entries)
    rows = {r.doc_id: r for r in responses.withColumn("applied", apply_corrections("original_text", "corrections")).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[1].corrected_text == "  The cat .\n\nIt saw a dog and the cat!  "
    for d, t in texts:
        assert rows[d].original_text == (t or "") and rows[d].applied == rows[d].corrected_text
        for c in rows[d].corrections:
            assert t[c.start:c.end] == c.value
    assert not rows[5].corrections and rows[2].corrections[0].asDict() == {"start": 0, "end": 3, "value": "teh", "replacement": "the"}


def test_lists_of_many_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("wrong;right\nx; one \ny;two\n" + "".join(f"k{i};{i}\n" for i in range(3000)))
    (tmp_path / "b.csv").write_text("x;header of b\ny;three\nalone\n")
    small = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        got = {r.wrong: r.right for r in read_correction_list(spark, str(tmp_path)).collect()}
        assert got.pop("x") == "one" and got.pop("y") == "three" and got == {f"k{i}": str(i) for i in range(3000)}
        (tmp_path / "t").mkdir()
        (tmp_path / "t" / "a.tsv").write_text("Tallinn\t10\nEesti\n")
        (tmp_path / "t" / "b.tsv").write_text("TALLINN\t3\neesti\tx\n")
        assert {(r.key, r.word, r.freq) for r in read_truecase_list(spark, str(tmp_path / "t")).collect()} == {("tallinn", "TALLINN", 3), ("eesti", "eesti", 5)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", small)
