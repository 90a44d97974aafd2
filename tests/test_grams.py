from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq

from chronotext.functions import grams
from chronotext.operators import features
from chronotext.streaming import stream as streaming


def _plain(texts, low, high):
    return Counter(t[i:i + n] for t in texts or () if t for n in range(low, high + 1) for i in range(len(t) - n + 1))


def test_grams_are_those_of_plain_python(monkeypatch):
    monkeypatch.setattr(grams, "SLICE", 8)   # several slices
    rows = [["abc", "ab"], None, [], ["\U0001F600a b", None, ""], ["x"], ["aa", "é\u0000é\u0000"], ["abcabcabcabc"]]
    for low, high in ((1, 3), (2, 5)):
        got = grams.counted(pa.array(rows, type=pa.list_(pa.string())), low, high).to_pylist()
        for texts, held in zip(rows, got, strict=True):
            assert {g["term"]: g["c"] for g in held} == _plain(texts, low, high)
            assert len(held) == len({g["term"] for g in held})


def test_counts_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "ab"), (1, "ab c"), (None, "a"), (None, "A"), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.c for r in features.CharNGrams(n=(1, 2)).counts(docs).collect()}
    assert got == {(1, "a"): 2, (1, "b"): 2, (1, "ab"): 2, (1, "b "): 1, (1, " "): 1, (1, " c"): 1, (1, "c"): 1, (None, "a"): 2}


def test_counting_shuffles_no_row_of_a_gram(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(20)], "doc_id long, text string").repartition(4, "doc_id")
    ex = features.CharNGrams().fit(docs)
    plan = ex.weights(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "InMemoryTableScan" not in plan and "term" not in "".join(
        line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_stream_of_one_file_and_of_part_files(spark, tmp_path):
    from chronotext.plans.queries import q_stream_char_ngrams
    rows = [(k, f"text number {k}", "en", "web", 9) for k in range(9)]
    docs = spark.createDataFrame(rows, streaming.DOCUMENT_SCHEMA)
    docs.repartition(3).write.parquet(f"file:{tmp_path}/many/documents.parquet")
    (tmp_path / "one").mkdir()
    pq.write_table(pa.Table.from_pandas(docs.toPandas()), tmp_path / "one" / "documents.parquet")
    for kind in ("many", "one"):
        assert q_stream_char_ngrams(spark, f"file:{tmp_path}/{kind}").select("doc_id").distinct().count() == 9


def test_values_are_made_in_the_row(spark):
    """No row of a gram is sorted, shuffled or joined for its norms or the vocabulary."""
    docs = spark.createDataFrame([(k, f"text {k}", k % 2) for k in range(20)], "doc_id long, text string, label int").repartition(4, "doc_id")
    ex = features.CharNGrams(norm=("l1", "l2")).fit(docs, carry=["label"])
    for out in (ex.transform(docs, carry=["label"]), ex.sums(docs, carry=["label"])):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Window", "Join", "Sort ")), plan
    # a slice gives one row for each label and gram
    assert ex.sums(docs.coalesce(1), carry=["label"]).groupBy("label", "term").count().where("count > 1").isEmpty()


def _by_key(df, *keys):
    out = {}
    for r in df.collect():
        out[tuple(r[k] for k in keys)] = out.get(tuple(r[k] for k in keys), 0.0) + r.value
    return out


def test_sent_and_joined_vocabularies_agree(spark, monkeypatch):
    """Repeated and null ids, labels that differ within a document, weights."""
    rows = [(1, "abc abd", 0, 2), (1, "abc", 1, 2), (2, "abc ab", 0, 1), (2, "abc ab", 0, 1), (None, "abx", None, 3), (None, "ab", 1, 1),
            (3, None, 0, 1), (4, "", 1, 1), (5, "zq", 0, 1), (6, "abc", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int, w long")
    for weight in (None, "w"):
        got = []
        for limit in (features.VOCABULARY_SENT, 0):
            monkeypatch.setattr(features, "VOCABULARY_SENT", limit)
            ex = features.CharNGrams(norm=("l1", "l2"), weight=weight).fit(docs, carry=["label"])
            full = ex.transform(docs, carry=["label"])
            short = ex.vocab.where("df < 6")
            sums = ex.sums(docs, carry=["label"])
            got.append([{r.term: r.df for r in ex.vocab.collect()}, _by_key(full, "doc_id", "label", "term"), _by_key(sums, "label", "term"),
                        {(r.label, r.term): r.n for r in sums.groupBy("label", "term").sum("n").withColumnRenamed("sum(n)", "n").collect()},
                        {r.doc_id: r.n_terms for r in ex.totals(docs).collect()}, {r.doc_id: r.found for r in ex.found(docs, short, "found").collect()}])
        for a, b in zip(*got, strict=True):
            assert a.keys() == b.keys()
            assert all(abs(a[k] - b[k]) < 1e-12 for k in a)
        counts = ex.counts(docs, carry=["label"])
        plain = features.terms.fit_vocabulary(counts, 3, weight)
        assert {r.term: r.df for r in plain.collect()} == got[0][0]


def test_texts_and_tokens_are_counted_once(spark):
    from chronotext.operators import features
    docs = spark.createDataFrame([(k, "abc def abd ab", k % 2) for k in range(9)], "doc_id long, text string, label int")
    toks = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "B")], "doc_id long, sent_no int, tok_no int, pos string")
    chars, tags = features.CharNGrams().fit(docs), features.TagNGrams("pos", n=(1, 2))
    made = [chars.transform(docs), chars.counts(docs), chars.totals(docs), chars.found(docs, chars.vocab, "n"), tags.fit_transform(toks, docs)]
    # a filter of what was counted called the function a second time
    assert [df._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") for df in made] == [1] * 5
    assert {r.n_terms for r in made[2].collect()} == {r.c for r in made[1].groupBy("doc_id").agg({"c": "sum"}).toDF("doc_id", "c").collect()}
