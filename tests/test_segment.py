import pytest
from pyspark.sql import functions as F

from chronotext.operators import segment


def _text(counts):
    # a sentence of k word tokens: "w w ... w."
    return " ".join(" ".join(["ww"] * k) + "." for k in counts)


def _merge(spark, counts, mode):
    df = spark.createDataFrame([(_text(counts),)], "t string")
    frags = segment.merge_short_sentences(segment.sentence_units(F.col("t")), 8, mode)
    return [f.n_tok for f in df.select(frags.alias("f")).first().f]


@pytest.mark.parametrize("counts,want", [
    ([3, 3, 3, 1, 1], [11 + 5]),   # one sentence of 11 words (+5 full stops)
    ([9, 2], [11 + 2]),
    ([2, 9], [11 + 2]),
    ([8, 8], [9, 9]),
])
def test_sentence_merge(spark, counts, want):
    assert _merge(spark, counts, "intended") == want
    assert _merge(spark, counts, "reference") == want


def test_short_alone(spark):
    assert _merge(spark, [3], "reference") == []
    assert _merge(spark, [3], "intended") == [4]
    df = spark.createDataFrame([("",)], "t string")
    f = segment.merge_short_sentences(segment.sentence_units(F.col("t")), 8, "intended")
    assert df.select(f.alias("f")).first().f == []


def _frags(spark, sizes):
    rows = [(f"f{i + 1}", n, i, i) for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(rows,)], "a array<struct<text:string,n_tok:int,first:int,last:int>>")
    return df


def test_windows(spark):
    df = _frags(spark, [3, 6, 2, 4])
    ref = df.select(segment.windows_reference(F.col("a"), 5).alias("w")).first().w
    assert [w.text for w in ref] == ["f2", "f1 f3 f4"]
    greedy = df.select(segment.windows_greedy(F.col("a"), 5).alias("w")).first().w
    assert [w.text for w in greedy] == ["f1 f2", "f3 f4"]
    small = _frags(spark, [1, 2]).select(segment.windows_reference(F.col("a"), 5).alias("w")).first().w
    assert [w.text for w in small] == ["f1 f2"]


def test_segment_index(spark):
    rows = [(0, "A_0", "full", 0), (1, "B_0", "full", 0), (2, "A_0", "full", 0), (3, "A_0", "full", 0)]
    df = spark.createDataFrame(rows, "doc_id long, name string, kind string, seg_no int")
    got = {r.doc_id: r.group for r in segment.segment_index(df, "name").collect()}
    assert [got[i] for i in range(4)] == ["A_0_0", "B_0_0", "A_0_1", "A_0_2"]


def test_policy_validation():
    with pytest.raises(ValueError):
        segment.Segmentation(split_policy="by_word")


def test_sentences_are_cut_once_for_reference_windows(spark):
    docs = spark.createDataFrame([(1, "One two. Three four five."), (2, None)], "doc_id long, text string")
    out = segment.Segmentation("by_sentence", 4, 1, mode="reference", keep_full=True).transform(docs)
    plan = out.where("kind = 'fragment'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
    assert [r.text for r in out.where("kind = 'fragment'").orderBy("seg_no").collect()] == ["Three four five.", "One two."]
