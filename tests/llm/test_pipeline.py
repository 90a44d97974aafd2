"""The pipeline's stages on a planted fixture, against plain Python."""

import random
import re
from collections import defaultdict

import corpus_pipeline
import pytest
from chronotext.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string"
SECRET = "password = 'hunter2hunter2hunter2'"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice(["an", "er", "tho", "in", "ble", "mo", "ka"]) for _ in range(rng.randrange(1, 5)))
    texts, toxic = [], []
    for k in range(260):
        words = [word() for _ in range(rng.randrange(30, 120))]
        if k % 4 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["grumbus", "Fozzle,", "snark!"])
        texts.append(" ".join(words))
        toxic.append(int(k % 4 == 0))
    rows = [(k, t, "en", "s", len(t), "x") for k, t in enumerate(texts)]
    clean = [k for k in range(260) if k % 4]
    add = lambda t: rows.append((len(rows) + 1000, t, None, None, None if t is None else len(t), None))
    for k in clean[:20]:
        add(texts[k].upper())  # equal but for case
    for k in clean[20:40]:
        add(texts[k] + " one more end")  # near copies
    for k in clean[40:50]:
        add(texts[k][: len(texts[k]) // 2] + " " + SECRET + " " + word())
    for t in ("", None, "   ", "long " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(15_000))):
        add(t)
    rows += [rows[clean[60]], (None, "nobody has this text at all, not even once", "en", None, None, None)]
    path = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, y, 1) for k, y in enumerate(toxic)], "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows


def shingles(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def plain_near(rows):
    """Of each class of linked texts the row of the smallest id; null ids last."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[root(i) if sets[i] else ("alone", i)].append(r)
    return [min(c, key=lambda r: (r[0] is None, r[0])) for c in classes.values()]


def test_stages_on_planted_documents(spark, planted):
    path, rows = planted
    docs = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact_dedup", "near_copies", "secrets", "packing"]
    key = lambda r: (r[0] is None, r[0], r[1] or "")
    run = lambda name, df: sorted((tuple(r) for r in stages[name](spark, df, path).collect()), key=key)

    model = toxicity.train(docs, spark.read.parquet(f"{path}/labels.parquet"))
    scores = {(r.doc_id, r.score) for r in toxicity.score(docs, model).collect()}
    low = {i for i, s in scores if s < toxicity.THRESHOLD}
    kept = run("toxicity", docs)
    assert kept == sorted((r for r in rows if r[0] in low), key=key)
    assert sum(r[0] is not None and r[0] < 260 and r[0] % 4 == 0 for r in kept) <= 3
    assert sum(r[0] is not None and (r[0] >= 260 or r[0] % 4) for r in kept) >= 240

    table = lambda rs: spark.createDataFrame(rs, SCHEMA).repartition(3)
    fold = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    best = {}
    for r in kept:
        if fold(r[1]) not in best or (r[0] is not None and (best[fold(r[1])][0] is None or r[0] > best[fold(r[1])][0])):
            best[fold(r[1])] = r
    unique = run("exact_dedup", table(kept))
    assert [(r[0], fold(r[1])) for r in unique] == [(r[0], fold(r[1])) for r in sorted(best.values(), key=key)]

    near = run("near_copies", table(unique))
    assert near == sorted(plain_near(unique), key=key)
    assert len(near) <= len(unique) - 15

    masked = run("secrets", table(near))
    assert len(masked) == len(near)
    for old, new in zip(near, masked, strict=True):
        if SECRET in (old[1] or ""):
            assert "hunter2" not in new[1] and new[4] == len(new[1])
        elif "<SECRET>" not in (new[1] or ""):
            assert new == old
    assert sum("<SECRET>" in (r[1] or "") for r in masked) >= 8

    pieces = stages["packing"](spark, table(masked), path).collect()
    total = defaultdict(int)
    for p in pieces:
        total[p.doc_id] += p.length
    assert all(total[p.doc_id] >= p.doc_tokens for p in pieces) and {p.doc_id for p in pieces} == {r[0] for r in masked}

    whole = corpus_pipeline.run(spark, path)
    assert sorted((p.doc_id is None, p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in whole.collect()) == \
        sorted((p.doc_id is None, p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)


def test_stages_of_an_empty_table(spark, planted):
    path, _ = planted
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, path)
        assert out.count() == 0
        assert name == "packing" or out.columns == empty.columns
