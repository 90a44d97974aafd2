"""Filter audit, hard negatives and source mixing against brute force."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from chronotext.llm import filter_audit, hard_negatives, source_mix

# --- filter audit ------------------------------------------------------------------------


def audit_rows():
    rng = random.Random(3)
    long_text = " ".join(f"w{k}" for k in range(260))
    texts = ["", None, long_text, long_text + " #", long_text.upper(), "a b c A", " ".join(["x", "y"] * 150), "ä ß € " * 90,
             "\x0b\x0c one\ttwo\r\nthree ", "z " * 60_000]
    rows = [(k, rng.choice(texts), rng.choice(["s", "t", None, ""]), "clash") for k in range(120)]
    return rows + [(None, long_text, "s", "n"), (None, None, None, None), (5, rows[5][1], "t", "again"), (7, "other text", "u", "again")]


def text_failures(text):
    words = re.findall(r"[^\x20\x09-\x0d]+", text)
    return {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}


def plain_audit(rows, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1 and i is not None} for k in (0, 1))
    least = {}
    for i, text, *_ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, part, *_ in rows:
        f = text_failures(text or "")
        f["E"] = i is not None and least[text or ""] < i
        fails.append((part or "", i, {k for k, v in f.items() if v}))
    out, shapley = {}, Counter()
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        for order in permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                gone = [(i, f) for i, f in left if c in f]
                left = [(i, f) for i, f in left if c not in f]
                shapley[part, c] += len(gone)
                out[part, "".join(order), k + 1] = (
                    len(left), len(gone), sum(c in f for _, f in own) - len(gone), sum(f == {c} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_filter_audit_is_the_plain_walk(spark):
    rows = audit_rows()
    labels = [(k, k % 3 == 0 and 1 or (None if k % 5 == 0 else 0), int(k % 4 == 0), "x") for k in range(0, 120, 2)] + [(4, 1, 1, "y"), (None, 1, 1, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, bits string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(docs, marks).collect()}
    assert got == plain_audit(rows, [x[:3] for x in labels])
    assert filter_audit.audit(docs.limit(0), marks).count() == 0
    assert filter_audit.audit(docs, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_copies_are_told_apart_by_text_when_hashes_are_equal(spark):
    rows = spark.createDataFrame([(1, 9, "a"), (2, 9, "b"), (3, 9, "a"), (0, 8, "b"), (4, 7, "c"), (None, 9, "a")], "doc_id long, hash long, text string")
    assert [r.doc_id for r in filter_audit.later_copies(rows).collect()] == [3]


# --- hard negatives ----------------------------------------------------------------------


def plain_negatives(rows, positives=5, negatives=5):
    held = []
    for key, vec, label in rows:
        if key is None or label is None or vec is None or any(v is None or not math.isfinite(v) for v in vec):
            continue
        held.append((key, [math.floor(256 * v) for v in vec], label))
    out = []
    for n, (key, vec, label) in enumerate(held):
        if key % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(vec, v, strict=True)), i, lab) for m, (i, v, lab) in enumerate(held) if m != n and len(v) == len(vec)]
        for s, i, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            found = sorted(x for x in scored if x[2] != label and -80 * s <= -100 * x[0] <= -100 * s)[:negatives]
            out += [(key, i, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(found)]
    return sorted(out)


def vectors():
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((4, 12))
    rows = []
    for k in range(900):
        v = centres[k % 4] + 0.6 * rng.standard_normal(12)
        v *= rng.choice([0.02, 0.3, 1.0, 5.0])
        rows.append((k, [float(x) for x in v], int(rng.integers(0, 4))))
    rows[3], rows[200], rows[300] = (3, None, 1), (200, [None] * 12, 1), (300, [float("nan")] * 12, 1)
    rows[400], rows[500] = (400, rows[400][1], None), (500, [0.0] * 12, 1)
    ties = [(1000 + k, rows[100][1], k % 3) for k in range(30)]  # equal vectors, ties by id
    short = [(2000, [1.0, 2.0], 1), (2001, [1.0, 2.0], 1), (2002, [0.9, 2.0], 2), (2100, [], 1), (2101, [], 1)]
    return rows + ties + short + [(None, rows[7][1], 1), (700, rows[100][1], 2), (2200, [1e300] * 12, 1)]


@pytest.mark.parametrize("size", [40, 4096])
def test_hard_negatives_are_those_of_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(hard_negatives, "BUCKET_ROWS", size)
    monkeypatch.setattr(hard_negatives, "ANCHOR_ROWS", 5)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<double>, label int, score double").repartition(4)
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == plain_negatives([r for r in rows if r[0] != 2200]) and len(got) > 100
    assert hard_negatives.mine(df.limit(0)).count() == 0


def test_pruning_keeps_every_vector_that_reaches_the_bound():
    rng = np.random.default_rng(8)
    for dim in (1, 2, 9):
        ints = rng.integers(-300, 300, (500, dim))
        bucket = hard_negatives.Bucket(ints, np.zeros(500, dtype=int))
        pruned = 0
        for anchor in rng.integers(-300, 300, (40, dim)):
            scores = ints @ anchor
            for least in {1, int(np.quantile(scores, 0.8)), int(scores.max()), int(scores.max()) + 1}:
                at = bucket.candidates(anchor, least)
                assert set(np.flatnonzero(scores >= least).tolist()) <= set(at.tolist())
                assert (bucket.products(anchor, at) == scores[at]).all()
                pruned += len(ints) - len(at)
        assert pruned > 1000


def test_large_components_are_multiplied_exactly():
    bucket = hard_negatives.Bucket(np.array([[2 ** 30, 3], [-(2 ** 30), 1]]), np.zeros(2, dtype=int))
    assert bucket.products(np.array([2 ** 30 + 1, 7]), np.arange(2)).tolist() == [2 ** 60 + 2 ** 30 + 21, -(2 ** 60) - 2 ** 30 + 7]


# --- source mixing -----------------------------------------------------------------------


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in names if s not in capped)
        over = {s for s in names if s not in capped and rest * weight[s] / free > most * sizes[s]} if free else set()
        if not over:
            return {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in names}
        capped |= over


def mix_rows():
    rng = random.Random(6)
    rows = [(k, " ".join(["w"] * int(rng.paretovariate(1.2))), rng.choice(["a", "b", "B", "é", None, "tiny"] + ["hot"] * 4), 0) for k in range(3000)]
    rows += [(None, "one two", "a", 1), (9000, None, "b", 1), (9001, "", None, 1), (9002, "x", "empty of words", 1), (9003, "", "no words", 1)]
    return rows + [(9100, "same " * 7, "hot", k) for k in range(500)] + [(9200, "long " * 30_000, "a", 1)]


def test_mix_reaches_its_targets(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int").repartition(3)
    options = dict(group=64)
    got = source_mix.plan_mix(df, **options).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0d]+", t or ""))
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((i, s, size(t)) for i, t, s, _ in rows)
    sizes, taken, counts = Counter(), Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies + r.part
        counts[r.source] += r.copies
        assert 0 <= r.copies <= 2 and 0 <= r.part <= r.size and r.size * r.copies + r.part <= 2 * r.size
    for s in {r[2] for r in rows}:
        sizes[s] += 0
    targets = plain_targets(sizes)
    by_source = defaultdict(list)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        by_source[r.source].append(r)
    for s, own in by_source.items():
        assert abs(taken[s] - targets[s]) < 0.51, s
        assert sum(r.part > 0 for r in own) <= 1
        if sizes[s]:
            assert abs(counts[s] - targets[s] / sizes[s] * len(own)) <= 3
    again = source_mix.plan_mix(df.repartition(7, "text"), **options).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    assert source_mix.plan_mix(df.limit(0)).count() == 0


def test_mixture_repeats_rows(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_id int").repartition(3)
    want = Counter()
    for r in source_mix.plan_mix(df, group=64).collect():
        want[r.doc_id, r.source, r.size] += r.copies
        want[r.doc_id, r.source, r.part] += r.part > 0
    out = source_mix.mixture(df, group=64)
    assert out.columns == df.columns
    got = Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    assert got == +want
    assert {r.mix_id for r in out.where("doc_id = 9100").collect()} <= set(range(500))


def test_flight_keeps_sums_and_expectations():
    sizes, p = [3, 50, 7, 7, 0, 12, 9, 30, 1, 1, 1, 4], 0.37
    hits = Counter()
    for seed in range(4000):
        rng = random.Random(seed)
        out = list(source_mix.flight(iter([(k, s, p) for k, s in enumerate(sizes)]), rng))
        assert sorted(k for k, _, _ in out) == list(range(len(sizes)))
        assert sum(q for _, _, q in out) == pytest.approx(p * len(sizes), abs=1e-6)
        assert sum(s * q for _, s, q in out) == pytest.approx(p * sum(sizes), abs=1e-5)
        left = [u for u in out if u[2] not in (0.0, 1.0)]
        assert len(left) <= 2 and len({u[1] for u in left}) == len(left)
        for k, _, q in out:
            hits[k] += q
        landed = list(source_mix.landing(left, rng))
        assert sum(q not in (0.0, 1.0) for _, _, q in landed) <= 1 and len(landed) == len(left)
        assert sum(s * q for _, s, q in landed) == pytest.approx(sum(s * q for _, s, q in left), abs=1e-6)
    assert all(abs(h / 4000 - p) < 0.04 for h in hits.values())
