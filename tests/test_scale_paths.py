"""Selection by threshold, medians by counting, committed results, leave-fold-out statistics, curves as steps."""

import random
import statistics
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.config import Config
from chronotext.operators import features, histogram, ordering, selection
from chronotext.plans import dating
from chronotext.sources import results


# --- selection ---------------------------------------------------------------------------

def scored(rng, n, values):
    return [("f", f"t{k:04d}", rng.choice(values)) for k in range(n)]


@pytest.mark.parametrize("values", [[0.0], [1.0, 2.0, 3.5, float("nan")], [k / 7 for k in range(300)], [1e-300, 2e-300, 5.0], [1.0, 1.0 + 2 ** -52, 2.0]])
def test_top_k_by_threshold_is_the_sorted_top_k(spark, monkeypatch, values):
    monkeypatch.setattr(selection, "TOP_REPORT", 5)
    monkeypatch.setattr(selection, "HISTOGRAM", 4)
    rows = scored(random.Random(len(values)), 200, values)
    df = spark.createDataFrame(rows, "fset string, term string, chi2 double").repartition(5)
    by_term = sorted(rows, key=lambda r: r[1], reverse=True)
    want = sorted(by_term, key=lambda r: (r[2] != r[2], -r[2] if r[2] == r[2] else 0))
    for k in (5, 6, 37, 120, 199, 200, 500):
        got = selection.select_top_k(df, k)
        assert got.columns == df.columns
        assert {r.term for r in got.collect()} == {r[1] for r in want[:k]}, k
    assert selection.select_top_k(df.limit(0), 50).count() == 0


def test_long_selection_has_no_task_for_all_terms(spark, monkeypatch):
    monkeypatch.setattr(selection, "TOP_REPORT", 5)
    df = spark.range(1000).select(F.lit("f").alias("fset"), F.col("id").cast("string").alias("term"), (F.col("id") % 97).cast("double").alias("chi2"))
    plan = selection.select_top_k(df, 800)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "SinglePartition" not in plan


# --- medians -----------------------------------------------------------------------------

def test_median_by_counting(spark):
    rng = random.Random(3)
    groups = {"a": [rng.random() for _ in range(501)], "b": [rng.choice([0.1, 0.2]) for _ in range(400)], "c": [7.5], "d": [-1e300, 1e300],
              "e": [1.7e308, -1.7e308, 0.0], "f": [5e-324, 0.0, 1e-323, 5e-324], None: [1.0, 2.0, 4.0, 8.0], "h": [0.3] * 50}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("a", None), ("z", None), ("z", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.median for r in ordering.exact_median(df, ["g"], "v", bins=8).collect()}
    assert got == {g: statistics.median(vs) for g, vs in groups.items()}
    out = ordering.exact_median(df, ["g"], "v")
    assert "rangepartitioning" not in out._jdf.queryExecution().executedPlan().toString()
    assert ordering.exact_median(df.limit(0), ["g"], "v").count() == 0


# --- results -----------------------------------------------------------------------------

def test_results_are_committed_once(spark, tmp_path):
    path = str(tmp_path / "results")
    pred = spark.createDataFrame([(k, k % 2, k % 2, 0.5 + k / 100) for k in range(6)], "doc_id long, label int, prediction int, proba double")
    rows = results.result_rows(pred, [0, 1])
    for fold in (0, 1, 0):
        results.commit_results(rows.where(F.col("doc_id") % 2 == fold), path, "first", fold)
    results.commit_results(rows.limit(1), path, "second", 0)
    got = results.load_committed(spark, path, "first").collect()
    assert sorted((r.doc_id, r.fold) for r in got) == [(k, k % 2) for k in range(6)]
    assert results.load_committed(spark, path).count() == 7


# --- the dating plan ---------------------------------------------------------------------

WORDS = {0: "alpha beta gamma delta", 1: "omega sigma kappa theta"}
SMALL = dict(segment_min_token_size=20, min_sentence_tokens=4, folds=2, c_grid=(1.0, 100.0))


def folded(spark, n=18, k=3):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lines = [f"{' '.join(rng.choices(WORDS[i % 2].split(), k=rng.randrange(2, 9)))} number {i} stands in line {j}." for j in range(rng.randrange(3, 8))]
        rows.append((i, " ".join(lines), i % 2, i % k))
    return spark.createDataFrame(rows, "doc_id long, text string, label int, fold int")


def table(df):
    return {(r.doc_id, r.fset, r.term): r.value for r in df.collect()}


@pytest.mark.parametrize("mode", ["intended", "reference"])
def test_fold_tables_by_subtraction_are_those_of_a_separate_fit(spark, mode):
    docs, cfg = folded(spark), Config(mode=mode, k=30, k_ratio=0.8, **SMALL)
    prepared = dating.prepare(docs, cfg)
    for fold in (0, 2):
        fv = dating.fold_vectors(prepared, fold, cfg)
        dev = dating.segment_rows(docs.where(F.col("fold") != fold), cfg)
        test = dating.segment_rows(docs.where(F.col("fold") == fold), cfg, fragments=False)
        weight = "row_w" if mode == "reference" else None
        want_dev, want_test = {}, {}
        for ex in dating.default_extractors(mode, weight):
            red = selection.FeatureSetReductor(ex, k=cfg.k, k_ratio=cfg.k_ratio, weight=weight)
            want_dev |= table(red.fit_transform(dev.rows, dev.toks))
            want_test |= table(red.transform(test.rows, test.toks))
        for got, want in ((fv.written_out("dev"), want_dev), (fv.written_out("test"), want_test)):
            got = table(got)
            curves = {k: v for k, v in want.items() if v != 0 or k[1].endswith("_length")}
            assert got.keys() == curves.keys()
            assert max(abs(got[k] - curves[k]) for k in got) < 1e-9
        fv.release()


def test_steps_add_up_to_the_curve(spark):
    rng = np.random.default_rng(2)
    rows = [(int(d), int(v)) for d in range(30) for v in rng.integers(0, 24, rng.integers(1, 40))] + [(99, 500)]
    values = spark.createDataFrame(rows, "doc_id long, v int")
    docs = spark.range(31).select(F.col("id").alias("doc_id")).unionByName(spark.createDataFrame([(99,)], "doc_id long"))
    dense = {(r.doc_id, r.bin): r.value for r in histogram.ecdf(values, docs, 20, "w").collect()}
    steps = histogram.steps(values, 20).collect()
    assert max(Counter(r.doc_id for r in steps).values()) <= 18 and 99 not in {r.doc_id for r in steps}
    grid = {d: np.zeros(19) for d in [*range(31), 99]}
    for r in steps:
        grid[r.doc_id][r.bin] += r.step
    for d, g in grid.items():
        assert np.allclose(np.cumsum(g)[1:], [dense[d, b] for b in range(1, 19)])
    normed = histogram.normalize_steps(histogram.steps(values, 20), 20).collect()
    for d in range(30):
        g = np.zeros(19)
        for r in normed:
            if r.doc_id == d:
                g[r.bin] = r.step
        n = np.linalg.norm(np.cumsum(g)[1:])
        assert n == pytest.approx(1.0) or not any(r.doc_id == d for r in normed)


def test_curve_scores_are_those_of_dense_rows(spark):
    docs = folded(spark)
    ex = features.WordLengths(upto=12)
    curves = histogram.normalize_steps(histogram.steps(ex.values(docs), 12), 12).join(docs.select("doc_id", "label"), "doc_id")
    got = {r.term: r.chi2 for r in selection.curve_chi2_scores(curves, docs, 12, "word_length", "word_length").collect()}
    dense = selection.FeatureSetReductor(ex)._reduce(ex.fit_transform(docs, carry=["label"]))
    want = {r.term: r.chi2 for r in selection.chi2_scores(dense, docs).collect()}
    assert got.keys() == want.keys()
    for t, v in want.items():
        assert got[t] == pytest.approx(v, abs=1e-9) or (v != v and got[t] != got[t])
