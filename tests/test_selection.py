import math
import random

from chronotext.operators import selection


def test_k_rule():
    assert selection.k_for(998, 5000, 0.8) == 998
    assert selection.k_for(4999, 5000, 0.8) == 4999
    assert selection.k_for(5000, 5000, 0.8) == 4000
    assert selection.k_for(6243, 5000, 0.8) == 4994


def _chi2_direct(rows, labels):
    classes = sorted(set(labels.values()))
    n = len(labels)
    out = {}
    for t in sorted({t for _, t, _ in rows}):
        ft = sum(v for d, tt, v in rows if tt == t)
        s = 0.0
        for c in classes:
            o = sum(v for d, tt, v in rows if tt == t and labels[d] == c)
            e = ft * sum(1 for d in labels if labels[d] == c) / n
            s += (o - e) ** 2 / e
        out[t] = s
    return out


def test_chi2_against_direct(spark):
    rnd = random.Random(7)
    labels = {d: rnd.randrange(3) for d in range(30)}
    rows = [(d, f"t{rnd.randrange(12)}", rnd.random()) for d in range(30) for _ in range(5)]
    agg = {}
    for d, t, v in rows:
        agg[(d, t)] = agg.get((d, t), 0.0) + v
    rows = [(d, t, v) for (d, t), v in agg.items()]
    f = spark.createDataFrame([(d, "x", t, v) for d, t, v in rows], "doc_id long, fset string, term string, value double")
    docs = spark.createDataFrame(list(labels.items()), "doc_id long, label int")
    got = {r.term: r.chi2 for r in selection.chi2_scores(f, docs).collect()}
    want = _chi2_direct(rows, labels)
    for t in want:
        assert math.isclose(got[t], want[t], rel_tol=1e-9, abs_tol=1e-9)


def test_top_k_ties_and_nan(spark):
    s = spark.createDataFrame([("x", "a", 1.0), ("x", "b", 1.0), ("x", "c", float("nan")), ("x", "d", 0.5)],
                              "fset string, term string, chi2 double")
    assert [r.term for r in selection.select_top_k(s, 1).collect()] == ["b"]
    assert [r.term for r in selection.select_top_k(s, 4).collect()] == ["b", "a", "d", "c"]
