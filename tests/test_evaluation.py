from collections import Counter

from pyspark.sql import functions as F

from chronotext.operators import evaluation, ordering


def test_running_index_matches_row_number(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("g"), F.col("id"))
    got = ordering.running_index(df, ["g"], [F.col("id").desc()], "k").collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.g, -r.id)):
        by.setdefault(r.g, []).append(r.k)
    assert all(v == list(range(len(v))) for v in by.values())


def test_exact_median(spark):
    df = spark.createDataFrame([(1, v) for v in [5.0, 1.0, 3.0]] + [(2, v) for v in [4.0, 1.0, 2.0, 3.0]],
                               "g int, v double")
    got = {r.g: r.median for r in ordering.exact_median(df, ["g"], "v").collect()}
    assert got == {1: 3.0, 2: 2.5}


def test_stratified_folds(spark):
    docs = spark.range(0, 203).select(F.col("id").alias("doc_id"), (F.col("id") % 4).cast("int").alias("label"))
    out = evaluation.stratified_group_folds(docs, 5).collect()
    assert len({r.doc_id for r in out}) == 203
    for lab in range(4):
        sizes = Counter(r.fold for r in out if r.label == lab)
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_confusion_and_metrics(spark):
    pred = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 2, 2)], "doc_id long, label int, prediction int")
    cm = {(r.label, r.prediction): r.n for r in evaluation.confusion(pred, [0, 1, 2, 3]).collect()}
    assert len(cm) == 16 and cm[(0, 1)] == 1 and cm[(3, 3)] == 0
    m = {r.label: r for r in evaluation.per_class_metrics(pred, [0, 1, 2, 3]).collect()}
    assert m[0].precision == 1.0 and m[0].recall == 0.5 and m[3].f1 == 1.0
    s = evaluation.summary_metrics(pred, [0, 1, 2, 3]).first()
    assert s.n == 4 and s.accuracy == 0.75


def test_centroid_distance_counts_absent_terms(spark):
    rows = [(1, "a", 1.0), (1, "b", 5.0), (2, "a", 0.9), (3, "a", 1.0)]
    f = spark.createDataFrame(rows, "doc_id long, term string, value double")
    docs = spark.createDataFrame([(1, 0, 0), (2, 1, 0), (3, 1, 1)], "doc_id long, label int, fold int")
    got = {(r.doc_id, r.cls): r.dist for r in evaluation.centroid_scores(f, docs, 2).collect()}
    assert abs(got[(3, 0)] - 25.0) < 1e-9 and abs(got[(3, 1)] - 0.01) < 1e-9


def test_median_of_ties_spreads_over_tasks(spark):
    df = spark.range(2000).selectExpr("0 as g", "case when id < 1980 then 1.0 else 2.0 end as v")
    assert ordering.exact_median(df, ["g"], "v").first()["median"] == 1.0


def test_shared_folder_is_required_on_a_cluster(spark, monkeypatch):
    import pytest

    from chronotext import session

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
