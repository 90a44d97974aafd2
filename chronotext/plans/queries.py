"""Registered queries: one per operator family, over the driver's tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose
columns are aliased exactly as in the matching oracle SQL
(:mod:`chronotext.plans.oracle`).  Floating values are rounded to 6 places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotext.config import Config
from chronotext.functions import rules
from chronotext.functions import text as tx
from chronotext.operators import annotate, features, labels, segment, selection
from chronotext.session import stored
from chronotext.sources import corpus

R = 6  # decimals kept in floating outputs
MIN_TOKENS = 8
SEG_TOKENS = 400  # segment_min_token_size of the reference configuration


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned corpus for queries that read it once; nothing is stored."""
    return corpus.load_documents(spark, sf_dir)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned, doc-partitioned corpus; persisted for queries that read
    its text in several branches."""
    return _rows(spark, sf_dir).persist()


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_encode(_docs(spark, sf_dir), rules.LANG_LABELS, "epoch")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and labels for queries that need no text; stored, so that it is scanned once."""
    return stored(labels.label_encode(corpus.document_labels(spark, sf_dir), rules.LANG_LABELS, "epoch"), "labels")


# --- sources, cleaning, labels --------------------------------------------

def q_corpus_clean(spark, sf_dir):
    return _rows(spark, sf_dir).select(*corpus.DOC_COLUMNS)


def q_corpus_filter_label(spark, sf_dir):
    d = corpus.load_documents(spark, sf_dir, skip_epochs=["ES"])
    return d.select("doc_id", "epoch")


def q_label_encode(spark, sf_dir):
    return _labels(spark, sf_dir).select("doc_id", "epoch", "label")


def q_class_balance(spark, sf_dir):
    return labels.class_balance(_labels(spark, sf_dir))


# --- segmentation ----------------------------------------------------------

def q_sentences(spark, sf_dir):
    d = _rows(spark, sf_dir)
    s = d.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent_no", "sentence"))
    return s.select("doc_id", F.col("sent_no").cast("int").alias("sent_no"), "sentence",
                    F.size(tx.tokens(F.col("sentence"))).alias("n_tokens"),
                    tx.n_word_tokens(F.col("sentence")).alias("n_words"))


def q_segments_endline(spark, sf_dir):
    d = _rows(spark, sf_dir)
    s = d.select("doc_id", F.posexplode(tx.endlines(F.col("text"))).alias("line_no", "line"))
    return s.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "line")


def _frag_rows(d: DataFrame, frags) -> DataFrame:
    s = d.select("doc_id", F.posexplode(frags).alias("seg_no", "f"))
    return s.select("doc_id", F.col("seg_no").cast("int").alias("seg_no"), F.col("f.text").alias("text"),
                    F.col("f.n_tok").alias("n_tok"), F.col("f.first").alias("first_sent"),
                    F.col("f.last").alias("last_sent"))


def q_sentence_merge(spark, sf_dir):
    d = _rows(spark, sf_dir)
    return _frag_rows(d, segment.merge_short_sentences(segment.sentence_units(F.col("text")), MIN_TOKENS))


def q_sentence_merge_reference(spark, sf_dir):
    d = _rows(spark, sf_dir)
    return _frag_rows(d, segment.merge_short_sentences(
        segment.sentence_units(F.col("text")), MIN_TOKENS, mode="reference"))


def q_windows_reference(spark, sf_dir):
    d = _rows(spark, sf_dir)
    sents = segment.merge_short_sentences(segment.sentence_units(F.col("text")), MIN_TOKENS, "reference")
    out = _frag_rows(d, segment.windows_reference(sents, SEG_TOKENS))
    return out.drop("first_sent", "last_sent")


def q_windows_greedy(spark, sf_dir):
    d = _rows(spark, sf_dir)
    sents = segment.merge_short_sentences(segment.sentence_units(F.col("text")), MIN_TOKENS)
    return _frag_rows(d, segment.windows_greedy(sents, SEG_TOKENS))


def q_windows_endline(spark, sf_dir):
    d = _rows(spark, sf_dir)
    return _frag_rows(d, segment.windows_greedy(segment.line_fragments(F.col("text")), SEG_TOKENS))


def q_segments_full(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    seg = segment.Segmentation("by_sentence", SEG_TOKENS, MIN_TOKENS).transform(d, keep=["label"])
    return seg.select("doc_id", "kind", "seg_no", "label", "n_tok", "first_sent", "last_sent")


def q_segment_index(spark, sf_dir):
    d = _docs(spark, sf_dir).withColumn("name", F.concat(F.col("filename"), F.lit("_0")))
    seg = segment.Segmentation("by_sentence", SEG_TOKENS, MIN_TOKENS).transform(d, keep=["name"])
    out = segment.segment_index(seg.drop("text"), "name")
    return out.select("doc_id", "kind", "seg_no", "group")


# --- annotation -------------------------------------------------------------

def q_tokens_tagged(spark, sf_dir):
    return annotate.tokens_table(_rows(spark, sf_dir))


def q_segment_token_join(spark, sf_dir):
    d = _docs(spark, sf_dir)
    seg = segment.Segmentation("by_sentence", SEG_TOKENS, MIN_TOKENS).transform(d)
    # added up by sentence where the tokens are made: sentences are joined, and tokens neither shuffled nor made twice
    sents = annotate.tokens_table(d).groupBy("doc_id", "sent_no").agg(
        F.count(F.lit(1)).alias("n"), F.min("start").alias("start"), F.max("end").alias("end")).persist()
    j = annotate.attach_by_sentence(seg, sents)
    return j.groupBy("doc_id", "kind", "seg_no").agg(
        F.sum("n").alias("n_tokens"), F.min("start").alias("first_char"), F.max("end").alias("last_char"))


def q_segment_locate_join(spark, sf_dir):
    d = _docs(spark, sf_dir)
    seg = segment.Segmentation("by_sentence", SEG_TOKENS, MIN_TOKENS).transform(d)
    ranged = annotate.segment_char_range(seg.where(F.col("kind") == "fragment"), d)
    j = annotate.attach_by_char_range(ranged, annotate.tokens_table(d))
    return j.groupBy("doc_id", "seg_no").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.min("start").alias("first_char"), F.max("end").alias("last_char"))


# --- features ----------------------------------------------------------------

def _rounded(df: DataFrame, cols=("value",)) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), R))
    return df


def q_word_length_ecdf(spark, sf_dir):
    f = features.WordLengths(upto=20).transform(_docs(spark, sf_dir))
    return _rounded(f.select("doc_id", "term", "value"))


def q_sentence_length_ecdf(spark, sf_dir):
    f = features.SentenceLengths(upto=1000).transform(_docs(spark, sf_dir))
    return _rounded(f.select("doc_id", "term", "value"))


def q_sentence_length_reference(spark, sf_dir):
    f = features.SentenceLengths(upto=1000, mode="reference").transform(_docs(spark, sf_dir))
    return _rounded(f.select("doc_id", "term", "value"))


def q_char_ngram_vocab(spark, sf_dir):
    m = features.CharNGrams().fit(_rows(spark, sf_dir))
    return m.vocab.select("term", "df")


def q_char_ngram_l1(spark, sf_dir):
    d = _docs(spark, sf_dir)   # fitted, then counted
    ex = features.CharNGrams()
    ex.fit(d)
    w = ex.weights(d)
    return _rounded(w.select("doc_id", "term", F.col("c").cast("long").alias("c"), "value"))


def q_char_ngram_totals(spark, sf_dir):
    d = _docs(spark, sf_dir)   # fitted, then counted
    ex = features.CharNGrams().fit(d)
    return ex.totals(d)


def q_punctuation_freq(spark, sf_dir):
    d = _rows(spark, sf_dir)
    ex = features.Punctuation()
    w = features.terms.normalize_rows(features.terms.tf_idf(ex.counts(d), 0, use_idf=False), "l1")
    return _rounded(w.select("doc_id", "term", F.col("c").cast("long").alias("c"), "value"))


def _tag_tfidf(spark, sf_dir, tag_col):
    toks = annotate.tokens_table(_rows(spark, sf_dir))   # counted once, and the counts stored
    f = features.TagNGrams(tag_col=tag_col, n=(1, 3)).fit_transform(toks, corpus.document_labels(spark, sf_dir))
    return _rounded(f.select("doc_id", "term", "value"))


def q_pos_ngram_tfidf(spark, sf_dir):
    return _tag_tfidf(spark, sf_dir, "pos")


def q_dep_ngram_tfidf(spark, sf_dir):
    return _tag_tfidf(spark, sf_dir, "dep")


# --- selection -----------------------------------------------------------------

def _char_scores(spark, sf_dir) -> DataFrame:
    """Char n-grams, L1 then L2 rows, against the four-class label."""
    d = _labelled(spark, sf_dir)
    f = features.CharNGrams(norm=("l1", "l2")).fit(d, carry=["label"]).sums(d, carry=["label"])
    return selection.chi2_scores(f, _labels(spark, sf_dir), "label")


def q_chi2_scores(spark, sf_dir):
    return _rounded(_char_scores(spark, sf_dir), ["chi2"])


def q_select_k_best(spark, sf_dir):
    scores = _char_scores(spark, sf_dir).persist()   # counted, then ranked
    k = selection.k_for(scores.count(), 5000, 0.8)
    top = selection.select_top_k(scores, k)
    return _rounded(top.select("term", "chi2"), ["chi2"])


def q_char_chi2_top20(spark, sf_dir):
    """Flagship: clean -> char 1-3-grams (min_df 3) -> L1 -> L2 -> chi2 vs the
    four-class label -> 20 best terms."""
    top = selection.select_top_k(_char_scores(spark, sf_dir), 20)
    return _rounded(top.select("term", "chi2"), ["chi2"])


QUERIES = {
    "corpus_clean": q_corpus_clean,
    "corpus_filter_label": q_corpus_filter_label,
    "label_encode": q_label_encode,
    "class_balance": q_class_balance,
    "sentences": q_sentences,
    "segments_endline": q_segments_endline,
    "sentence_merge": q_sentence_merge,
    "sentence_merge_reference": q_sentence_merge_reference,
    "windows_reference": q_windows_reference,
    "windows_greedy": q_windows_greedy,
    "windows_endline": q_windows_endline,
    "segments_full": q_segments_full,
    "segment_index": q_segment_index,
    "tokens_tagged": q_tokens_tagged,
    "segment_token_join": q_segment_token_join,
    "segment_locate_join": q_segment_locate_join,
    "word_length_ecdf": q_word_length_ecdf,
    "sentence_length_ecdf": q_sentence_length_ecdf,
    "sentence_length_reference": q_sentence_length_reference,
    "char_ngram_vocab": q_char_ngram_vocab,
    "char_ngram_l1": q_char_ngram_l1,
    "char_ngram_totals": q_char_ngram_totals,
    "punctuation_freq": q_punctuation_freq,
    "pos_ngram_tfidf": q_pos_ngram_tfidf,
    "dep_ngram_tfidf": q_dep_ngram_tfidf,
    "chi2_scores": q_chi2_scores,
    "select_k_best": q_select_k_best,
    "char_chi2_top20": q_char_chi2_top20,
}


# --- oversampling (binary stand-in: toxic vs. not, documents with labels) ---

from chronotext.operators import dro, evaluation  # noqa: E402

RATIO = 0.5
SEED = 0


def _binary(spark, sf_dir) -> DataFrame:
    return _docs(spark, sf_dir).join(_toxic(spark, sf_dir), "doc_id")


def _toxic(spark, sf_dir) -> DataFrame:
    return corpus.read_table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("int").alias("label"))


def _binary_labels(spark, sf_dir) -> DataFrame:
    """Ids and binary labels for queries that need no text; stored, so that it is scanned once."""
    return stored(corpus.document_labels(spark, sf_dir).select("doc_id").join(_toxic(spark, sf_dir), "doc_id"), "labels")


def _binary_x(spark, sf_dir):
    d = _binary(spark, sf_dir)
    ex = features.CharNGrams()
    return d, ex, ex.fit_transform(d, carry=["label"])


def _binary_sums(spark, sf_dir):
    """``_binary_x`` added up by label: for queries that only count or sum over documents."""
    d = _binary(spark, sf_dir)
    return d, features.CharNGrams().fit(d, carry=["label"]).sums(d, carry=["label"])


def _kept_x(spark, sf_dir):
    """``_binary_x`` for queries that draw: its rows are read many times, so they are stored."""
    d, ex, x = _binary_x(spark, sf_dir)
    return d, ex, stored(x, "features")


def q_dro_samples(spark, sf_dir):
    return dro.samples_to_match_ratio(_binary_labels(spark, sf_dir), RATIO, seed=SEED)


def q_dro_replicate(spark, sf_dir):
    d = _binary_labels(spark, sf_dir)
    s = dro.samples_to_match_ratio(d, RATIO, seed=SEED)
    return dro.replicate(d.select("doc_id", "label"), s).select("doc_id", "copy_no", "label")


def q_contingency(spark, sf_dir):
    d, x = _binary_sums(spark, sf_dir)
    return dro.contingency(x, d)


def q_info_gain(spark, sf_dir):
    d, x = _binary_sums(spark, sf_dir)
    return _rounded(dro.information_gain(dro.contingency(x, d)).select("term", "ig"), ["ig"])


def q_tpr_fpr(spark, sf_dir):
    d, x = _binary_sums(spark, sf_dir)
    return _rounded(dro.tpr_fpr(dro.contingency(x, d)), ["tpr", "fpr"])


def q_dro_weights(spark, sf_dir):
    d, _, x = _binary_x(spark, sf_dir)
    ig = dro.information_gain(dro.contingency(x, d))
    w = dro.weight_matrix(x, ig)
    return w.select("term", "doc_id", F.round(F.col("weight") * 1e6, R).alias("weight_e6"))


def q_dro_latent_draws(spark, sf_dir):
    """Latent term counts for every oversampled training row (rows-only)."""
    d, ex, x = _kept_x(spark, sf_dir)
    words = ex.totals(d).select("doc_id", F.col("n_terms").alias("n_words"))
    m = dro.DistributionalRandomOversampling(RATIO, seed=SEED).fit(x, d)
    samples = stored(dro.samples_to_match_ratio(d, RATIO, seed=SEED), "samples")
    return dro.latent_draws(x, m.ig, m.train_x, words, samples, SEED)


# --- folds, weights, scorer, metrics ----------------------------------------

K = 5
CLASSES = sorted(rules.LANG_LABELS.values())


def _folded(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return evaluation.stratified_group_folds(d, K, "label", "doc_id", SEED)


def q_folds_stratified(spark, sf_dir):
    folds = evaluation.stratified_group_folds(_labels(spark, sf_dir), K, "label", "doc_id", SEED)
    return folds.select("doc_id", "label", "fold")


def q_class_weights(spark, sf_dir):
    return _rounded(evaluation.class_weights(_labels(spark, sf_dir)), ["weight"])


def q_loo_stats(spark, sf_dir):
    """Leave-one-out statistics by subtraction: training size, own-class
    training size and char n-gram vocabulary size without the document."""
    d = _labels(spark, sf_dir)
    ex = features.CharNGrams()
    docs = _docs(spark, sf_dir)
    vocab_all = stored(features.terms.fit_vocabulary(ex.frequencies(docs), 1, "n"), "vocabulary")
    n_vocab = vocab_all.where(F.col("df") >= ex.min_df).count()
    lost = ex.found(docs, vocab_all.where(F.col("df") == ex.min_df), "lost")
    n = d.count()
    per_class = d.groupBy("label").agg(F.count(F.lit(1)).alias("nc"))
    out = d.select("doc_id", "label").join(per_class, "label").join(lost, "doc_id", "left")
    return out.select("doc_id", F.lit(n - 1).cast("long").alias("n_train"),
                      (F.col("nc") - 1).cast("long").alias("class_train"),
                      (F.lit(n_vocab) - F.coalesce(F.col("lost"), F.lit(0))).cast("long").alias("vocab_loo"))


def _centroid_pred(spark, sf_dir):
    docs = _folded(spark, sf_dir)
    f = features.WordLengths(upto=20).transform(docs)
    return evaluation.predict_nearest(evaluation.centroid_scores(f, docs, K))


def q_centroid_predictions(spark, sf_dir):
    return _rounded(_centroid_pred(spark, sf_dir), ["proba"])


def q_accuracy_prf(spark, sf_dir):
    m = evaluation.per_class_metrics(_centroid_pred(spark, sf_dir), CLASSES)
    return _rounded(m, ["precision", "recall", "f1"])


def q_accuracy_summary(spark, sf_dir):
    return _rounded(evaluation.summary_metrics(_centroid_pred(spark, sf_dir), CLASSES), ["accuracy", "macro_f1"])


def q_confusion_matrix(spark, sf_dir):
    return evaluation.confusion(_centroid_pred(spark, sf_dir), CLASSES)


def q_posterior_median(spark, sf_dir):
    return _rounded(evaluation.posterior_median(_centroid_pred(spark, sf_dir), ["fold"]), ["posterior_median"])


QUERIES.update({
    "dro_samples": q_dro_samples,
    "dro_replicate": q_dro_replicate,
    "contingency": q_contingency,
    "info_gain": q_info_gain,
    "tpr_fpr": q_tpr_fpr,
    "dro_weights": q_dro_weights,
    "dro_latent_draws": q_dro_latent_draws,
    "folds_stratified": q_folds_stratified,
    "class_weights": q_class_weights,
    "loo_stats": q_loo_stats,
    "centroid_predictions": q_centroid_predictions,
    "accuracy_prf": q_accuracy_prf,
    "accuracy_summary": q_accuracy_summary,
    "confusion_matrix": q_confusion_matrix,
    "posterior_median": q_posterior_median,
})


# --- sources and sinks -------------------------------------------------------

from chronotext.operators import model as lr  # noqa: E402
from chronotext.plans import dating  # noqa: E402
from chronotext.session import scratch_path  # noqa: E402
from chronotext.sources import cache as annotation_cache  # noqa: E402
from chronotext.sources import results  # noqa: E402


def q_corpus_json_roundtrip(spark, sf_dir):
    """Write the corpus as JSON corpus objects, read it back through the
    loader (blank-content, trim, filename and cleaning rules)."""
    path = scratch_path(spark, "corpus-json")
    corpus.write_corpus_json(corpus.records_from_documents(corpus.read_table(spark, sf_dir, "documents")),
                             path, lines=False)
    return corpus.load_corpus_json(spark, path, multiline=False).select(*corpus.DOC_COLUMNS)


def q_results_append(spark, sf_dir):
    """Two runs appended to one results table, read back."""
    pred = _centroid_pred(spark, sf_dir)
    rows = results.result_rows(pred, CLASSES)
    path = scratch_path(spark, "results")
    results.save_results(rows, path)
    results.save_results(rows, path)
    back = results.load_results(spark, path)
    out = back.groupBy("doc_id", "label").agg(
        F.count(F.lit(1)).alias("n_runs"), F.first(F.element_at("prediction", 1)).alias("prediction"),
        F.first("accuracy").alias("accuracy"), F.first("proba").alias("proba"))
    return _rounded(out, ["accuracy", "proba"])


def _token_summary(toks: DataFrame) -> DataFrame:
    return toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"),
                                      F.countDistinct("sent_no").alias("n_sentences"),
                                      F.max("end").alias("last_char"))


def q_annotate_incremental(spark, sf_dir):
    """Cache filled with the English documents, then every document is
    requested: only the others are annotated."""
    d = _docs(spark, sf_dir)
    c = annotation_cache.AnnotationCache(spark, scratch_path(spark, "annotations"))
    c.annotate(d.where(F.col("epoch") == "en"))
    return _token_summary(c.annotate(d))


def q_cache_delete(spark, sf_dir):
    """Every document annotated, then the French ones deleted (new version)."""
    d = _docs(spark, sf_dir)
    c = annotation_cache.AnnotationCache(spark, scratch_path(spark, "annotations"))
    c.annotate(d)
    c.delete_docs(d.where(F.col("epoch") == "fr").select("doc_id"))
    return _token_summary(c.table())


def q_corpus_json_lines_ids(spark, sf_dir):
    """The corpus as one file of JSON lines without ids; ids are the lines' numbers."""
    path = scratch_path(spark, "json-lines")
    records = corpus.records_from_documents(corpus.read_table(spark, sf_dir, "documents"))
    records.orderBy("doc_id").select(*corpus.RECORD_FIELDS).write.json(path)
    return corpus.load_corpus_json(spark, path, multiline=False, number_lines=True).select(*corpus.DOC_COLUMNS)


def q_cache_reopened(spark, sf_dir):
    """Annotated by one instance, again by a second, deletion by a third, read by a fourth."""
    d = _docs(spark, sf_dir)
    path = scratch_path(spark, "annotations")
    annotation_cache.AnnotationCache(spark, path).annotate(d.where(F.col("epoch") == "en"))
    annotation_cache.AnnotationCache(spark, path).annotate(d)
    annotation_cache.AnnotationCache(spark, path).delete_docs(d.where(F.col("epoch") == "fr").select("doc_id"))
    return _token_summary(annotation_cache.AnnotationCache(spark, path).table())


# --- frozen transform, feature index, stacking, model --------------------------

def _benchmark_docs(spark, sf_dir):
    b = corpus.read_table(spark, sf_dir, "benchmark")
    rec = b.select(F.col("item_id").cast("long").alias("doc_id"), F.lit("").alias("Title"),
                   F.col("text").alias("Content"), F.lit("").alias("Epoch"), F.lit("").alias("Language"),
                   F.lit("").alias("Area"))
    return corpus.prepare_documents(rec)


def q_transform_unseen(spark, sf_dir):
    """Char n-gram vocabulary fitted on the corpus, frozen, applied to the
    unseen benchmark texts (unseen grams dropped, L1 over the rest)."""
    ex = features.CharNGrams().fit(_docs(spark, sf_dir))
    w = ex.weights(_benchmark_docs(spark, sf_dir))
    return _rounded(w.select("doc_id", "term", F.col("c").cast("long").alias("c"), "value"))


def q_feature_index(spark, sf_dir):
    """Column ranges of the stacked matrix: word-length bins, then the
    chi2-selected char n-grams."""
    scores = _char_scores(spark, sf_dir).persist()   # counted, then ranked
    k = selection.k_for(scores.count(), 5000, 0.8)
    chosen = selection.select_top_k(scores, k).select("fset", "term")
    names = features.feature_names(20).select(F.lit("word_length").alias("fset"), F.col("name").alias("term"))
    return selection.feature_index(names.unionByName(chosen), dating.SET_ORDER)


def _dev_test(spark, sf_dir):
    docs = _folded(spark, sf_dir)
    return docs.where(F.col("fold") != 0).drop("fold"), docs.where(F.col("fold") == 0).drop("fold")


def q_feature_vectors(spark, sf_dir):
    """All four families fitted on the documents and fragments of folds 1-4,
    applied to fold 0, each reduced to its chi2 top-k, stacked (rows-only)."""
    fv = dating.extract_feature_vectors(*_dev_test(spark, sf_dir))
    return fv.written_out("dev").withColumn("split", F.lit("dev")).unionByName(fv.written_out("test").withColumn("split", F.lit("test")))


def q_lr_grid_cv(spark, sf_dir):
    """Grid of C x class weight on stratified folds of the development set;
    returns the mean accuracy of every grid point (rows-only)."""
    dev, test = _dev_test(spark, sf_dir)
    fv = dating.extract_feature_vectors(dev, test)
    _, table, _ = dating.grid_search(fv, dev, Config(folds=K, random_state=SEED))
    fv.release()
    return spark.createDataFrame(table, "C double, class_weight string, mean_accuracy double")


def q_lr_predictions(spark, sf_dir):
    """Fold 0 scored by the refitted best model (rows-only)."""
    docs = _folded(spark, sf_dir)
    pred, _, _ = dating.score_fold(docs, 0)
    return pred


QUERIES.update({
    "corpus_json_roundtrip": q_corpus_json_roundtrip,
    "corpus_json_lines_ids": q_corpus_json_lines_ids,
    "cache_reopened": q_cache_reopened,
    "results_append": q_results_append,
    "annotate_incremental": q_annotate_incremental,
    "cache_delete": q_cache_delete,
    "transform_unseen": q_transform_unseen,
    "feature_index": q_feature_index,
    "feature_vectors": q_feature_vectors,
    "lr_grid_cv": q_lr_grid_cv,
    "lr_predictions": q_lr_predictions,
})


# --- streaming ------------------------------------------------------------------

from chronotext.streaming import stream as streaming  # noqa: E402


def q_stream_char_ngrams(spark, sf_dir):
    """The documents file read as a stream; every micro-batch is featurised
    with the frozen char n-gram vocabulary fitted on the corpus."""
    ex = features.CharNGrams().fit(_docs(spark, sf_dir))
    ex.vocab = ex.vocab.persist()
    sink = scratch_path(spark, "stream-sink")
    q = streaming.featurize_stream(
        # a pattern matches one file as well as a folder of part files
        streaming.document_stream(spark, f"{sf_dir.rstrip('/')}/documents.parque[t]"),
        ex, sink, scratch_path(spark, "stream-checkpoint"))
    q.awaitTermination()
    out = spark.read.parquet(sink).drop("epoch")
    return _rounded(out)


QUERIES["stream_char_ngrams"] = q_stream_char_ngrams


def q_dro_fit_transform(spark, sf_dir):
    """DRO on the binary stand-in: observed rows replicated by their copy
    counts plus tf-idf weighted latent terms for every copy (rows-only)."""
    d, ex, x = _kept_x(spark, sf_dir)
    words = ex.totals(d).select("doc_id", F.col("n_terms").alias("n_words"))
    train, _, _ = dro.oversample_family(x.select("doc_id", "fset", "term", "value"), d, words, ratio=RATIO, seed=SEED)
    return train.select("doc_id", "copy_no", "fset", "term", "value")


def q_dro_tile_lengths(spark, sf_dir):
    """Oversampling of a family without term totals (word-length curve):
    training rows replicated, test rows tiled 100 times (rows-only)."""
    d = _binary(spark, sf_dir)
    folds = evaluation.stratified_group_folds(d.select("doc_id", "label"), K, "label", "doc_id", SEED)
    wl = features.WordLengths(upto=20).transform(d).join(folds, "doc_id")
    dev_docs = folds.where(F.col("fold") != 0)
    train, _, test = dro.oversample_family(wl.where(F.col("fold") != 0).drop("fold", "label"), dev_docs, None,
                                           ratio=RATIO, seed=SEED, test_x=wl.where(F.col("fold") == 0)
                                           .drop("fold", "label"))
    out = train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))
    return _rounded(out.select("doc_id", "fset", "term", "value", "copy_no", "split"))


QUERIES["dro_fit_transform"] = q_dro_fit_transform
QUERIES["dro_tile_lengths"] = q_dro_tile_lengths


def q_weighted_vocab(spark, sf_dir):
    """Reference-mode multiplicity: every training document appears once per
    segment (whole document + fragments) with identical features; carried as
    a weight w, document frequency = sum of w (so a document with w >= 3
    passes min_df alone)."""
    d = _docs(spark, sf_dir)
    seg = segment.Segmentation("by_sentence", SEG_TOKENS, MIN_TOKENS, mode="reference").transform(d)
    w = seg.groupBy("doc_id").agg(F.count(F.lit(1)).cast("long").alias("w"))
    found = features.CharNGrams(weight="w").frequencies(d.join(w, "doc_id"))   # the weight joins texts, not their grams
    return features.terms.fit_vocabulary(found, 3, weight_col="n")   # n: sums of w


def q_segment_data(spark, sf_dir):
    """Development segments (whole documents and fragments of folds 1-4)
    and test segments of fold 0, split into whole documents and fragments."""
    d = _folded(spark, sf_dir)
    seg = segment.Segmentation("by_sentence", SEG_TOKENS, MIN_TOKENS).transform(d, keep=["label", "fold"])
    split = (F.when(F.col("fold") != 0, F.lit("dev"))
             .when(F.col("kind") == "full", F.lit("test")).otherwise(F.lit("test_fragment")))
    return seg.select("doc_id", "kind", "seg_no", "label", split.alias("split"), "n_tok")


def q_reduce_unseen(spark, sf_dir):
    """Reductor transform on unseen texts: char n-grams with the frozen
    vocabulary, L1, L2, keep the chi2-selected terms fitted on the corpus."""
    d = _labelled(spark, sf_dir)
    red = selection.FeatureSetReductor(features.CharNGrams(), k=5000, k_ratio=0.8)
    red.fit_transform(d)
    b = _benchmark_docs(spark, sf_dir).withColumn("label", F.lit(0))
    return _rounded(red.transform(b).select("doc_id", "term", "value"))


QUERIES["weighted_vocab"] = q_weighted_vocab
QUERIES["segment_data"] = q_segment_data
QUERIES["reduce_unseen"] = q_reduce_unseen


def q_segment_tokens_reference(spark, sf_dir):
    """Reference attach rule: every segment (whole document and each
    fragment) carries the whole document's annotation; kept as a weight w
    per document instead of w copies of its token rows."""
    d = _docs(spark, sf_dir)
    seg = segment.Segmentation("by_sentence", SEG_TOKENS, MIN_TOKENS, mode="reference").transform(d)
    toks = annotate.attach_whole_document(seg, annotate.tokens_table(d))
    return toks.groupBy("doc_id").agg(F.first("w").cast("long").alias("w"),
                                      F.count(F.lit(1)).alias("n_tokens"),
                                      (F.first("w") * F.count(F.lit(1))).cast("long").alias("weighted_tokens"))


QUERIES["segment_tokens_reference"] = q_segment_tokens_reference


def q_segment_features(spark, sf_dir):
    """Rows of the model (documents and fragments), each with the number of
    its tokens attached by sentence and of its char n-grams in the vocabulary
    fitted on all rows."""
    seg = dating.segment_rows(_labelled(spark, sf_dir))
    chars = features.CharNGrams().fit(seg.rows).totals(seg.rows)
    toks = seg.toks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    out = seg.rows.join(toks, "doc_id", "left").join(chars, "doc_id", "left")
    return out.select(F.col("doc_id").alias("row_id"), F.col("parent_id").alias("doc_id"), "kind", "label",
                      "n_tokens", F.col("n_terms").alias("n_grams"))


def q_dating_run(spark, sf_dir):
    """Every document scored over two outer folds with the default families,
    result rows appended to a table and read back (rows-only).  The grid is
    three strengths and both class weights, on two inner folds."""
    path = scratch_path(spark, "dating-results")
    dating.run(_labelled(spark, sf_dir), Config(c_grid=(1.0, 100.0, 10000.0), folds=2), folds=2, results_path=path)
    return results.load_committed(spark, path)


def q_function_words(spark, sf_dir):
    """Function words per document; the words are the most frequent ones of
    the corpus itself, as the fixed list of the configuration is empty."""
    d = _docs(spark, sf_dir)
    words = d.select(F.explode(tx.word_tokens(F.col("text"))).alias("term")).groupBy("term").count()
    top = words.orderBy(F.col("count").desc(), "term").limit(50)
    return features.function_word_counts(d, [r["term"] for r in top.collect()])   # 50 words


QUERIES.update({
    "segment_features": q_segment_features,
    "dating_run": q_dating_run,
    "function_words": q_function_words,
})


def _draws_input(spark, sf_dir):
    d, ex, x = _kept_x(spark, sf_dir)
    words = ex.totals(d).select("doc_id", F.col("n_terms").alias("n_words"))
    m = dro.DistributionalRandomOversampling(RATIO, seed=SEED).fit(x, d)
    return x, m, words, dro.samples_to_match_ratio(d, RATIO, seed=SEED)


def q_dro_latent_expected(spark, sf_dir):
    """Exact expected draws of every latent document over all oversampled rows."""
    x, m, words, samples = _draws_input(spark, sf_dir)
    return dro.expected_draws(x, m.ig, m.train_x, words, samples).withColumn("expected", F.round("expected", 3))


def q_dro_draw_totals(spark, sf_dir):
    """Latent terms drawn for every copy: as many as its row has terms."""
    x, m, words, samples = _draws_input(spark, sf_dir)
    drawn = dro.latent_draws(x, m.ig, m.train_x, words, samples, SEED)
    return drawn.groupBy("doc_id", "copy_no").agg(F.sum("n").alias("n_drawn"))


def q_dro_transform(spark, sf_dir):
    """DRO fitted on folds 1-4 and applied to the documents of fold 0, two
    copies each given as a table: observed terms and the length of the latent
    vector of every copy."""
    d = evaluation.stratified_group_folds(_binary(spark, sf_dir), K, "label", "doc_id", SEED).persist()
    dev, test = d.where(F.col("fold") != 0), d.where(F.col("fold") == 0)
    ex = features.CharNGrams()
    x = stored(ex.fit_transform(dev, carry=["label"]), "features")
    words = ex.totals(dev).select("doc_id", F.col("n_terms").alias("n_words"))
    m = dro.DistributionalRandomOversampling(RATIO, seed=SEED)
    m.fit_transform(x.drop("label"), dev.select("doc_id", "label"), words)
    copies = test.select("doc_id", F.lit(2).alias("copies"))
    out = m.transform(stored(ex.transform(test), "features"), ex.totals(test).withColumnRenamed("n_terms", "n_words"), copies)
    latent = F.col("fset") == m.fset
    return _rounded(out.groupBy("doc_id", "copy_no").agg(
        F.count(F.when(~latent, 1)).alias("n_observed"),
        F.sqrt(F.sum(F.when(latent, F.col("value") * F.col("value")))).alias("latent_norm")), ["latent_norm"])


def q_punctuation_totals(spark, sf_dir):
    return features.Punctuation().totals(_rows(spark, sf_dir))


def q_pos_ngram_totals(spark, sf_dir):
    toks = annotate.tokens_table(_rows(spark, sf_dir))   # counted once, and the counts stored
    return features.TagNGrams("pos", n=(1, 3)).fit(toks, corpus.document_labels(spark, sf_dir)).totals(toks)


def q_drop_null(spark, sf_dir):
    """Lines as segments; those without a word have no annotation and go."""
    lines = _rows(spark, sf_dir).select("doc_id", F.posexplode(tx.endlines(F.col("text"))).alias("line_no", "line"))
    annotated = F.when(tx.n_word_tokens(F.col("line")) > 0, F.col("line"))
    kept = labels.drop_null_segments(lines.withColumn("text", annotated))
    return kept.select("doc_id", F.col("line_no").cast("int").alias("line_no"), "text")


QUERIES.update({
    "dro_latent_expected": q_dro_latent_expected,
    "dro_draw_totals": q_dro_draw_totals,
    "dro_transform": q_dro_transform,
    "punctuation_totals": q_punctuation_totals,
    "pos_ngram_totals": q_pos_ngram_totals,
    "drop_null": q_drop_null,
})
