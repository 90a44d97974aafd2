import pandas as pd
from pyspark.sql import functions as F

from chronotext.operators import annotate, segment


def test_user_tagger_plugs_in(spark):
    # defined here so that it is shipped to the Python workers by value
    def _whitespace_tagger(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(pdf["doc_id"], pdf["text"]):
            pos = 0
            for k, tok in enumerate(text.split()):
                start = text.index(tok, pos)
                pos = start + len(tok)
                rows.append((doc_id, 0, k, start, pos, tok, "X" if tok.isalpha() else "", "dep"))
        return pd.DataFrame(rows, columns=["doc_id", "sent_no", "tok_no", "start", "end", "text", "pos", "dep"])

    docs = spark.createDataFrame([(1, "alpha beta 42"), (2, "gamma")], "doc_id long, text string")
    toks = annotate.annotate_with(docs, _whitespace_tagger)
    got = sorted((r.doc_id, r.tok_no, r.text, r.start, r.end, r.pos) for r in toks.collect())
    assert got == [(1, 0, "alpha", 0, 5, "X"), (1, 1, "beta", 6, 10, "X"), (1, 2, "42", 11, 13, ""),
                   (2, 0, "gamma", 0, 5, "X")]


def test_default_tokens_and_sentence_attach(spark):
    docs = spark.createDataFrame([(1, "Ab cd ef gh ij kl mn op. Qr st uv wx yz ab cd ef! X1 2")], "doc_id long, text string")
    toks = annotate.tokens_table(docs)
    rows = sorted((r.sent_no, r.tok_no, r.text, r.pos, r.dep) for r in toks.collect())
    assert rows[0] == (0, 0, "Ab", "FUNC", "ROOT>FUNC")
    assert (2, 0, "X1", "MIX", "ROOT>MIX") in rows and (2, 1, "2", "NUM", "MIX>NUM") in rows
    seg = segment.Segmentation("by_sentence", tokens_per_fragment=5, min_tokens=8).transform(docs)
    j = annotate.attach_by_sentence(seg, toks)
    per = {(r.kind, r.seg_no): r.n for r in j.groupBy("kind", "seg_no").agg(F.count("*").alias("n")).collect()}
    assert per[("full", 0)] == len(rows) and sum(v for (k, _), v in per.items() if k == "fragment") == len(rows)


def test_a_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path / "loads")

    def load():
        import os
        with open(log, "a") as f:  # local test: all workers share this machine
            f.write(f"{os.getpid()}\n")

        def tag(pdf: pd.DataFrame) -> pd.DataFrame:
            rows = [(d, 0, 0, 0, len(t), t, "X", f"pid{os.getpid()}") for d, t in zip(pdf["doc_id"], pdf["text"])]
            return pd.DataFrame(rows, columns=["doc_id", "sent_no", "tok_no", "start", "end", "text", "pos", "dep"])
        return tag

    docs = spark.range(64).select(F.col("id").alias("doc_id"), F.lit("word").alias("text")).repartition(24)
    for _ in range(2):
        got = annotate.annotate_with(docs, loader=load, name=f"model {log}").collect()
        assert len(got) == 64
    loads = open(log).read().split()
    assert len(loads) == len(set(loads)) < 48 and {f"pid{p}" for p in loads} >= {r.dep for r in got}


def test_sentences_are_joined_with_segments_and_not_tokens(spark, tmp_path):
    from chronotext.plans.queries import q_segment_token_join
    rows = [(k, f"One two three, {k}. Four five! Six seven eight nine ten eleven twelve thirteen.", "en", "web", 9) for k in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file:{tmp_path}/documents.parquet")
    out = q_segment_token_join(spark, f"file:{tmp_path}")
    got = {(r.doc_id, r.kind, r.seg_no): (r.n_tokens, r.first_char, r.last_char) for r in out.collect()}
    whole = {(k, kind, 0): (18, 0, len(t) ) for k, t, *_ in rows for kind in ("full", "fragment")}
    assert got == whole
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate posexplode(regexp_extract_all" not in plan.split("InMemoryRelation")[0]
