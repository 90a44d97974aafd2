import json
import os

from pyspark.sql import functions as F

from chronotext.session import scratch_path
from chronotext.sources import cache, corpus


def _write_object_file(path, docs):
    local = path.replace("file:", "")
    os.makedirs(local, exist_ok=True)
    with open(os.path.join(local, "corpus.json"), "w", encoding="utf-8") as f:
        json.dump({"Documents": docs}, f)


def test_reference_layout_and_loader_rules(spark):
    path = scratch_path(spark, "corpus-test")
    _write_object_file(path, [
        {"Title": "A B", "Content": "<b>Hello</b> World ", "Epoch": "Church Slavonic"},
        {"Title": "blank", "Content": "   ", "Epoch": "Church Slavonic"},
        {"Title": "empty tag", "Content": "<b></b>", "Epoch": "Church Slavonic"},
        {"Title": "skip me", "Content": "text", "Epoch": " RUTHENIAN "},
        {"Content": "no title"},
    ])
    all_docs = {r.title: r for r in corpus.load_corpus_json(spark, path).collect()}
    assert "blank" not in all_docs and "skip me" in all_docs
    assert all_docs["A B"].text == "hello world" and all_docs["A B"].filename == "A_B"
    assert all_docs["empty tag"].text == ""
    assert all_docs[""].text == "no title" and all_docs[""].epoch == ""
    kept = {r.title for r in corpus.load_corpus_json(spark, path, skip_epochs=["Ruthenian"]).collect()}
    assert "skip me" not in kept and "A B" in kept


def test_annotation_cache_incremental_and_delete(spark):
    docs = spark.createDataFrame([(1, "one two. three"), (2, "four five")], "doc_id long, text string")
    c = cache.AnnotationCache(spark, scratch_path(spark, "cache-test"))
    first = c.annotate(docs.where("doc_id = 1"))
    assert first.count() == 4  # one two . three
    both = c.annotate(docs)
    assert both.groupBy("doc_id").count().count() == 2 and both.count() == 6
    edited = docs.withColumn("text", F.when(F.col("doc_id") == 2, F.lit("four")).otherwise(F.col("text")))
    assert c.annotate(edited).where("doc_id = 2").count() == 1
    c.delete_docs(docs.where("doc_id = 1").select("doc_id"))
    assert c.table().where("doc_id = 1").count() == 0


def test_cache_goes_on_after_reopening(spark):
    docs = spark.createDataFrame([(1, "one two. three"), (2, ""), (3, "four five")], "doc_id long, text string")
    path = scratch_path(spark, "cache-test")
    cache.AnnotationCache(spark, path).annotate(docs.where("doc_id < 3"))
    assert cache.AnnotationCache(spark, path).annotate(docs).count() == 6
    cache.AnnotationCache(spark, path).delete_docs(docs.where("doc_id = 1").select("doc_id"))
    assert cache.AnnotationCache(spark, path).table().count() == 2


def test_json_lines_need_ids_or_numbering(spark):
    import pytest
    path = scratch_path(spark, "lines")
    spark.createDataFrame([(f"t{i}", f"text {i}") for i in range(50)], "Title string, Content string") \
        .repartition(3).write.json(path)
    got = corpus.load_corpus_json(spark, path, multiline=False, number_lines=True).collect()
    assert sorted(r.doc_id for r in got) == list(range(50))
    with pytest.raises(Exception, match="no doc_id"):
        corpus.load_corpus_json(spark, path, multiline=False).collect()


def test_cache_finds_asked_tokens_without_a_join_when_all_are_asked(spark, tmp_path):
    from chronotext.sources.cache import AnnotationCache
    docs = spark.createDataFrame([(1, "Ab cd. Ef"), (2, "gh"), (3, "ij kl"), (4, None)], "doc_id long, text string")
    c = AnnotationCache(spark, str(tmp_path / "annotations"))
    part = c.annotate(docs.where("doc_id = 1"))
    whole = c.annotate(docs)
    assert "Join" not in whole._jdf.queryExecution().optimizedPlan().toString()   # every token was joined with its key before
    assert sorted((r.doc_id, r.text) for r in part.collect()) == [(1, "."), (1, "Ab"), (1, "Ef"), (1, "cd")]
    assert {r.doc_id for r in whole.collect()} == {1, 2, 3} and whole.count() == 7
    assert {r.doc_id for r in c.lookup(docs.where("doc_id > 1")).collect()} == {2, 3}
    c.delete_docs(docs.where("doc_id = 2").select("doc_id"))
    assert {r.doc_id for r in c.table().collect()} == {1, 3}
