"""M1-M5 properties and M20-M29 metrics on small tables."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window

from proflex.operators import evaluation as ev
from proflex.operators.sampling import hash_order, salted_rank, stratified_folds, train_split
from proflex.operators.sampling import test_split as make_test_split


def base(spark, n=400):
    rows = [(i, ["A2", "B1", "B2", "C1"][i % 4], [None, "personal letter", "semiformal letter"][i % 3])
            for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, prof_level string, text_type string")


def test_split_disjoint_and_complete(spark):
    b = base(spark)
    te = make_test_split(b)
    tr = train_split(b, te)
    assert te.join(tr, "doc_id").count() == 0
    assert te.count() + tr.count() == b.count()
    per = {(r.prof_level, r.text_type): r["count"] for r in te.groupBy("prof_level", "text_type").count().collect()}
    assert per[("A2", "personal letter")] == 10  # 30 / 3 types (a missing type counts)
    assert sum(v for (lv, _), v in per.items() if lv == "C1") == 30


def test_salted_rank_equals_global_rank(spark):
    b = base(spark, 2000)
    order = hash_order(0, "doc_id", "fold")
    exact = b.withColumn("r0", F.row_number().over(Window.partitionBy("prof_level").orderBy(order, "doc_id")))
    salted = salted_rank(b, ["prof_level"], order, "doc_id", "r1")
    assert exact.join(salted, "doc_id").where("r0 <> r1").count() == 0


def test_folds_balanced(spark):
    f = stratified_folds(base(spark), k=10)
    counts = [r["count"] for r in f.groupBy("prof_level", "fold").count().collect()]
    assert max(counts) - min(counts) <= 1 and f.count() == 400


def preds(spark):
    rows = [(1, "A2", "A2"), (2, "A2", "B1"), (3, "B1", "B1"), (4, "B1", "B1"), (5, "C1", "B1")]
    return spark.createDataFrame(rows, "doc_id long, label string, prediction string")


def test_report_and_matrix(spark):
    rep = {r.row: r for r in ev.classification_report(preds(spark)).collect()}
    assert rep["A2"].precision == 1.0 and rep["A2"].recall == 0.5
    assert rep["B1"].precision == pytest.approx(2 / 4) and rep["B1"].recall == 1.0
    assert rep["C1"].f1 == 0.0  # zero_division = 0
    assert rep["accuracy"].f1 == pytest.approx(3 / 5)
    cm = {(r.label, r.prediction): r.n for r in ev.confusion_matrix(preds(spark)).collect()}
    assert cm[("C1", "B1")] == 1 and sum(cm.values()) == 5
    assert ev.balanced_accuracy(preds(spark)).first()[0] == pytest.approx((0.5 + 1 + 0) / 3)


def test_rank_and_rename(spark):
    imp = spark.createDataFrame([("word_count", 0.1, 0.0), ("MTLD", -0.2, 0.0)],
                                "feature string, importance_mean double, importance_sd double")
    r = {x.feature: x.rank for x in ev.rank_importances(imp).collect()}
    assert r == {"MTLD": 1, "word_count": 2}
    named = ev.rename_labels(imp, "feature").collect()
    assert {x.feature for x in named} == {"word count", "MTLD"}
