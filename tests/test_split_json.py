"""One JSON object read by byte ranges, against the reader that takes a file whole."""

import json
import random

import pytest

from chronotext.sources import corpus


def write(path, rng, n, indent=None):
    texts = ["plain", 'a "quoted" word', "a { brace } and ] [ , more }", "back\\slash \\\" }", "line\nbreak\ttab", "Жаß \U0001f600 }{", "}" * 30, '"' * 9, ""]
    docs = []
    for k in range(n):
        d = {"Title": f"T{k}", "Content": f"{rng.choice(texts)} {k} {rng.choice(texts)}", "Epoch": rng.choice(["a", "b"]), "Language": "x", "Area": rng.choice(texts)}
        if rng.random() < 0.1:
            d.pop("Area")
        if rng.random() < 0.1:
            d["Area"] = None
        docs.append(d)
    path.write_text(json.dumps({"Documents": docs}, ensure_ascii=rng.random() < 0.5, indent=indent), encoding="utf-8")


@pytest.mark.parametrize("size", ["300b", "4k", "64m"])
def test_byte_ranges_give_the_same_documents(spark, tmp_path, size):
    rng = random.Random(len(size))
    write(tmp_path / "a.json", rng, 120)
    write(tmp_path / "b.json", rng, 80, indent=2)
    write(tmp_path / "c.json", rng, 0)
    write(tmp_path / "d.json", rng, 1)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = sorted(map(tuple, corpus.load_corpus_json(spark, str(tmp_path)).collect()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    want = sorted(map(tuple, corpus.load_corpus_json(spark, str(tmp_path), split=False).collect()))
    assert len(want) > 190

    def by_text(rows):  # an empty file has a number in one reader only
        return sorted((r[0] & 0xffffffff, *r[1:]) for r in rows)
    assert by_text(got) == by_text(want)


def test_other_layouts_are_refused(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"Other": 1, "Documents": [{"Title": "a", "Content": "b"}]}')
    with pytest.raises(Exception, match="not a record"):
        corpus.load_corpus_json(spark, str(tmp_path)).collect()
