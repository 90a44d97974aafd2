import math

from pyspark.sql import functions as F

from chronotext.operators import features, histogram, terms


def test_ecdf_fixture(spark):
    vals = spark.createDataFrame([(1, v) for v in [1, 1, 2, 18, 19, 20]] + [(2, 30)], "doc_id long, v int")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    out = {(r.doc_id, r.bin): r.value for r in histogram.ecdf(vals, docs, 20, "word_length").collect()}
    assert len(out) == 2 * 18
    assert math.isclose(out[(1, 1)], 0.4)
    assert all(math.isclose(out[(1, b)], 0.6) for b in range(2, 18))
    assert math.isclose(out[(1, 18)], 1.0)
    assert all(out[(2, b)] == 0.0 for b in range(1, 19))
    ref = histogram.ecdf(vals, docs, 20, "word_length", mode="reference").where("doc_id = 2").collect()
    assert all(math.isnan(r.value) for r in ref)


def test_tag_ngrams(spark):
    toks = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "B"), (1, 1, 0, "C"), (1, 1, 1, "")],
                                 "doc_id long, sent_no int, tok_no int, pos string")
    got = sorted(r.term for r in features.tag_ngrams(toks, "pos", (1, 2)).collect())
    assert got == sorted(["A", "B", "A-B", "C", "Unk", "C-Unk"])


def test_tfidf_weights(spark):
    c = spark.createDataFrame([(1, "t", 3, 1)], "doc_id long, term string, c long, df long")
    r = terms.tf_idf(c, 4, use_idf=True, sublinear_tf=True).first()
    idf = math.log(5 / 2) + 1
    assert math.isclose(idf, 1.916291, abs_tol=1e-6)
    assert math.isclose(r.value, (1 + math.log(3)) * idf)
    assert math.isclose(1 + math.log(3), 2.098612, abs_tol=1e-6)


def test_normalize_zero_row(spark):
    w = spark.createDataFrame([(1, "a", 3.0), (1, "b", 4.0), (2, "a", 0.0)], "doc_id long, term string, value double")
    got = {(r.doc_id, r.term): r.value for r in terms.normalize_rows(w, "l2").collect()}
    assert math.isclose(got[(1, "a")], 0.6) and math.isclose(got[(1, "b")], 0.8) and got[(2, "a")] == 0.0


def test_char_ngram_vocab_min_df(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "ab"), (4, "ac")], "doc_id long, text string")
    m = features.CharNGrams(min_df=3).fit(docs)
    assert sorted(r.term for r in m.vocab.collect()) == ["a", "ab", "b"]
    w = {(r.doc_id, r.term): r.value for r in m.weights(docs).collect()}
    assert math.isclose(w[(1, "ab")], 1 / 3) and w[(4, "a")] == 1.0


def test_weighted_document_frequency(spark):
    # reference multiplicity as a weight: a document counted 3 times passes min_df=3 alone
    counts = spark.createDataFrame([(1, "z", 2, 3), (2, "y", 1, 1), (3, "y", 1, 1)],
                                   "doc_id long, term string, c long, w long")
    v = {r.term: r.df for r in terms.fit_vocabulary(counts, 3, weight_col="w").collect()}
    assert v == {"z": 3}


def test_function_word_counts(spark):
    docs = spark.createDataFrame([(1, "The cat and the dog"), (2, "no match here")], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.c for r in features.function_word_counts(docs, ["the", "and"]).collect()}
    assert got == {(1, "the"): 2, (1, "and"): 1}
    assert features.function_word_counts(docs, ["zzz"]).count() == 0


def test_tag_counts_are_made_in_rows_and_kept_on_disk(spark):
    rows = [(1, 0, 1, "B", 1), (1, 0, 0, "A", 2), (1, 1, 0, "A", 3), (2, 0, 0, "", 4), (None, 0, 0, "A", 5), (None, 0, 1, "A", 6)]
    toks = spark.createDataFrame(rows, "doc_id long, sent_no int, tok_no int, pos string, p int")
    docs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id long")
    ex = features.TagNGrams("pos", n=(1, 2))
    out = ex.fit_transform(toks, docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    # counts were held in executors' memory, and joined and sorted as rows, before
    assert "InMemoryRelation" not in plan and "Window" not in plan and "Join" not in plan
    counts = {(1, "A"): 2, (1, "B"): 1, (1, "A-B"): 1, (2, "Unk"): 1, (None, "A"): 2, (None, "A-A"): 1}
    assert {(r.doc_id, r.term): r.c for r in ex.counts(toks).collect()} == counts
    df = {"A": 2, "B": 1, "A-B": 1, "Unk": 1, "A-A": 1}
    assert {r.term: r.df for r in ex.vocab.collect()} == df and ex.n_docs == 4
    raw = {k: (1 + math.log(c)) * (math.log(5 / (1 + df[k[1]])) + 1) for k, c in counts.items()}
    norm = {d: math.sqrt(sum(v * v for k, v in raw.items() if k[0] == d)) for d in (1, 2, None)}
    got = {(r.doc_id, r.term): r.value for r in out.collect()}
    assert got.keys() == raw.keys() and all(math.isclose(v, raw[k] / norm[k[0]]) for k, v in got.items())
    assert {r.doc_id: r.n_terms for r in ex.totals(toks).collect()} == {1: 4, 2: 1, None: 3}
