"""Exact dedup, the n-gram join, embeddings and repeated strings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronotext.llm import bucket_join, embedding_dedup, exact_dedup, ngram_join, suffix_dedup


def text_of(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# --- exact dedup -------------------------------------------------------------------------

def exact_rows():
    rng = random.Random(5)
    texts = [text_of(rng, 30) for _ in range(40)] + ["", None, "ABC Ä", "abc Ä", "abc ä", "z" * 200_000]
    rows = [(k, rng.choice(texts), f"s{k}") for k in range(400)]
    return rows + [(None, "only here", "n"), (None, "only here", "m"), (7, rows[7][1], "twice"), (900, "only", "o")]


@pytest.mark.parametrize("budget", [64 << 20, 2000])
def test_duplicate_report(spark, budget):
    rows = exact_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    groups = defaultdict(list)
    for key, text, _ in rows:
        groups[exact_dedup.normalise(text)].append(key)
    got = exact_dedup.duplicate_report(df, budget=budget).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(groups)
    by_sha = {hashlib.sha256(c).hexdigest(): g for c, g in groups.items()}
    for r in got:
        keys = by_sha[r.text_sha256]
        best = max((k for k in keys if k is not None), default=None)
        assert r.group_size == len(keys) and r.keep_id == best and r.doc_id in keys
        assert not r.kept or r.doc_id == best


def test_drop_copies_keeps_whole_rows(spark):
    rows = exact_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, ROW_NO string").repartition(5)
    got = exact_dedup.drop_copies(df, budget=2000).collect()
    assert len(got) == len({exact_dedup.normalise(t) for _, t, _ in rows})
    assert {tuple(r) for r in got} <= {tuple(r) for r in rows}
    assert exact_dedup.drop_copies(df.limit(0)).columns == df.columns
    assert exact_dedup.duplicate_report(df.limit(0)).count() == 0


# --- n-gram join -------------------------------------------------------------------------

def jaccard_classes(rows):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None)
    n, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                parent[root(i)] = root(j)
    low = defaultdict(list)
    for i, (key, _) in enumerate(rows):
        low[root(i)].append((key is None, key))
    return [(key, min(low[root(i)])[1] if sets[i] else key, n[i]) for i, (key, _) in enumerate(rows)]


def near_rows():
    rng = random.Random(8)
    rows = []
    for _ in range(25):
        base = text_of(rng, rng.randrange(3, 200)).split()
        for _ in range(rng.randrange(1, 6)):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(999)}"
            rows.append((len(rows), " ".join(copy)))
    return rows + [(3, rows[3][1]), (None, rows[9][1]), (500, ""), (501, None), (502, "  "), (503, "Two Words"), (504, "two words"), (505, text_of(rng, 30_000))]


def test_near_texts_against_all_pairs(spark, monkeypatch):
    rows = near_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")
    key = lambda r: tuple((x is None, x) for x in r)
    want = sorted(jaccard_classes(rows), key=key)
    got = ngram_join.near_texts(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=key) == want
    left = ngram_join.drop_near_copies(df)
    assert left.columns == df.columns
    assert left.count() == sum(r.kept for r in got)


def test_large_nodes_are_split_or_cut_into_blocks(spark):
    rng = random.Random(2)
    passage = text_of(rng, 60)
    rows = [(k, passage + " " + text_of(rng, 40)) for k in range(60)]
    base = text_of(rng, 120).split()
    for k in range(60, 110):
        copy = list(base)
        copy[rng.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shingler = ngram_join.Shingler()
    functions = ngram_join._functions(ngram_join.VALUES)
    sketches = spark.createDataFrame([(k, bytes(ngram_join.min_hashes(s, functions).astype("<u8").tobytes()))
                                      for (k, _), s in zip(rows, shingler.sets([t for _, t in rows]), strict=True)], "item long, payload binary")
    nodes = ngram_join.split_large(ngram_join.paths(sketches, 11, 0.8), sketches, 0.8, large=12)
    sizes = {r.node: r["size"] for r in nodes.select("node", "size").distinct().collect()}
    assert max(sizes.values()) >= 40 and sum(v > 12 for v in sizes.values()) < len(sizes)
    sets = spark.createDataFrame([(k, 1, bytes(s.astype("<u8").tobytes())) for (k, _), s in zip(rows, shingler.sets([t for _, t in rows]), strict=True)],
                                 "item long, n long, payload binary")
    counts, edges = bucket_join.links(nodes, sets, ngram_join._jaccard(0.8), block=8)
    got = {r.item: r.links for r in counts.collect()}
    want = {key: n for key, _, n in jaccard_classes(rows) if n}
    assert got == want
    labels = {r.item: r.component for r in bucket_join.components(edges).collect()}
    assert {labels[k] for k in range(60, 110)} == {60}
    assert df.count() == 110


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(200, 260)] + [(1, k) for k in range(2, 150)] + [(700, 699)]
    got = {r.item: r.component for r in bucket_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(200, 261)} == {200} and {got[k] for k in range(1, 150)} == {1} and got[700] == 699
    assert bucket_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- embeddings --------------------------------------------------------------------------

def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        base = rng.standard_normal(32)
        for _ in range(rng.integers(1, 8)):
            rows.append((len(rows), int(rng.integers(0, 2)), (base + 0.12 * rng.standard_normal(32)).tolist()))
    rows += [(len(rows), 0, rows[0][2]), (None, 0, rows[0][2]), (5, 1, rows[5][2]), (900, None, rows[0][2]), (901, 0, None), (902, 0, []),
             (903, 0, [0.0] * 32), (904, 0, [float("nan")] * 32), (905, 0, [1e-200] * 32), (906, 0, [1e200] * 32), (907, 0, [1.0] * 31 + [None]), (908, 0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, n_links string")
    units = [None if r[1] is None else embedding_dedup._unit(r[2]) for r in rows]
    n = [sum(a is not None and b is not None and i != j and len(a) == len(b) and rows[i][1] == rows[j][1] and a @ b >= 0.93
             for j, b in enumerate(units)) for i, a in enumerate(units)]
    got = embedding_dedup.near_vectors(df).collect()
    assert len(got) == len(rows)
    found, want = Counter((r.vec_id, r.n_links) for r in got), Counter(zip((r[0] for r in rows), n, strict=True))
    assert sum(r.n_links for r in got) <= sum(n)
    assert sum((found & want).values()) >= 0.9 * len(rows)
    assert {r.vec_id: r.n_links for r in got}[905] == 1 and {r.vec_id: r.n_links for r in got}[903] == 0
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize("common", [0.0, 0.6, 0.8])
def test_recall_of_pairs_at_the_limit_around_a_common_direction(spark, common):
    rng, pairs, dim = np.random.default_rng(7), 1200, 64
    m = np.zeros(dim)
    m[0] = common ** 0.5
    e = rng.standard_normal((2, pairs, dim))
    e[:, :, 0] = 0
    e[0] /= np.linalg.norm(e[0], axis=1, keepdims=True)
    e[1] -= (e[0] * e[1]).sum(axis=1, keepdims=True) * e[0]
    e[1] /= np.linalg.norm(e[1], axis=1, keepdims=True)
    c = 1 - (1 - 0.935) / (1 - common)  # so that a pair is at cosine 0.935
    x = m + (1 - common) ** 0.5 * np.concatenate([e[0], c * e[0] + (1 - c * c) ** 0.5 * e[1]])
    want = int(((x @ x.T >= 0.93).sum() - len(x)) // 2)
    df = spark.createDataFrame([(k, 1, v.tolist()) for k, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    found = sum(r.n_links for r in embedding_dedup.near_vectors(df).collect()) // 2
    assert want >= pairs and 0.95 * want <= found <= want


def test_tables_for_few_vectors():
    rng = np.random.default_rng(3)
    for x in (np.eye(4)[:1], np.eye(2), np.array([[1.0, 0.0, 0.0], [0.94, (1 - 0.94 ** 2) ** 0.5, 0.0]]), np.ones((1, 1))):
        rotations, n = embedding_dedup.fit_tables(x, 6, 8, 0.93, 0.98, rng)
        assert n >= 8 and sum(r.shape[1] for _, r in rotations) >= 6 * n


def test_plan_follows_size():
    assert embedding_dedup.table_plan(0, 0.93)[0] == 6
    assert embedding_dedup.table_plan(10 ** 9, 0.93)[0] > embedding_dedup.table_plan(10 ** 4, 0.93)[0]


# --- repeated strings --------------------------------------------------------------------

def repeat_rows():
    rng = random.Random(6)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    shared = [word(rng.randrange(150, 500)) for _ in range(4)]
    rows = [(k, word(rng.randrange(0, 300)) + rng.choice(shared) + word(rng.randrange(0, 300)) + rng.choice(["", *shared]))
            for k in range(60)]
    return rows + [(100, "ab" * 400), (101, "q" * 199), (102, "q" * 201), (103, ""), (None, None), (104, word(600)), (4, rows[4][1]),
                   (105, rows[9][1]), (106, word(5000))]


@pytest.mark.parametrize("group", [512, 3])
def test_remove_repeats_against_counted_windows(spark, group):
    rows = repeat_rows()
    bodies = [(t or "").encode() for _, t in rows]
    seen = Counter(b[i:i + 200] for b in bodies for i in range(len(b) - 199))
    want = []
    for (key, _), b in zip(rows, bodies, strict=True):
        gone = np.zeros(len(b) + 1, dtype=bool)
        for i in range(len(b) - 199):
            if seen[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.append((key, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, anchor int")
    got = [tuple(r) for r in suffix_dedup.remove_repeats(df, group=group).collect()]
    order = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=order) == sorted(want, key=order)
    if group == 512:
        assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def test_suffix_sort_orders_bytes():
    rng = np.random.default_rng(2)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    pos, group = np.arange(500), np.repeat([0, 1, 2], [250, 1, 249])
    order = suffix_dedup._suffix_sort(data, suffix_dedup.PrefixHashes(data), pos, group, 200)
    keys = [(group[i], bytes(data[pos[i]:pos[i] + 200])) for i in order]
    assert keys == sorted(keys)


def test_suffix_sort_against_counted_strings():
    rng = np.random.default_rng(5)
    for trial in range(120):
        length = int(rng.choice([1, 3, 8, 9, 20, 40]))
        low, high = ((254, 256), (0, 2))[trial % 2]
        parts, strings, group = [], [], []
        for g in range(int(rng.integers(1, 6))):
            for _ in range(int(rng.integers(1, 9))):
                k = int(rng.integers(1, 30))
                body = rng.integers(low, high, k + length - 1).astype(np.uint8).tobytes()
                if parts and rng.random() < 0.4:  # like the part before, to its end or from it on
                    body = (parts[-1] * 3 + body)[:k + length - 1] if parts[-1] else body
                    body += b"x" * (k + length - 1 - len(body))
                parts.append(body)
                strings.append(k)
                group.append(g)
        got = suffix_dedup.repeated_strings(parts, np.array(strings), np.array(group), length)
        keys = [(group[i], parts[i][j:j + length]) for i in range(len(parts)) for j in range(strings[i])]
        counts = Counter(keys)
        assert got.tolist() == [counts[k] > 1 for k in keys]
