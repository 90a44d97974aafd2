from pyspark.sql import functions as F

from chronotext.operators import features, histogram, segment
from chronotext.sources import corpus

SF = "/root/testdata/sf0.001"


def _rows(df, cols):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_transform_of_fit_docs_equals_fit_transform(spark):
    d = corpus.load_documents(spark, SF)
    a = features.CharNGrams().fit_transform(d)
    m = features.CharNGrams().fit(d)
    b = m.transform(d)
    assert _rows(a, ["doc_id", "term", "value"]) == _rows(b, ["doc_id", "term", "value"])


def test_invariant_under_repartition(spark):
    d3 = corpus.load_documents(spark, SF, partitions=3)
    d11 = corpus.load_documents(spark, SF, partitions=11)
    v3 = features.CharNGrams().fit(d3).vocab
    v11 = features.CharNGrams().fit(d11).vocab
    assert _rows(v3, ["term", "df"]) == _rows(v11, ["term", "df"])
    s3 = segment.segment_index(segment.Segmentation().transform(d3, keep=["filename"]))
    s11 = segment.segment_index(segment.Segmentation().transform(d11, keep=["filename"]))
    assert _rows(s3, ["doc_id", "kind", "seg_no", "group"]) == _rows(s11, ["doc_id", "kind", "seg_no", "group"])


def test_ecdf_properties(spark):
    d = corpus.load_documents(spark, SF)
    f = features.WordLengths(upto=20).transform(d)
    per = f.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("value").alias("mx"),
                                  F.min("value").alias("mn")).collect()
    assert all(r.n == 18 and r.mn >= 0.0 and r.mx <= 1.0 + 1e-12 for r in per)
    last = f.where(F.col("term") == "word_length_18").where(F.col("value") > 0)
    assert all(abs(r.value - 1.0) < 1e-12 for r in last.collect())
