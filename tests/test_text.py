from pyspark.sql import functions as F

from chronotext.functions import text as tx

CLEAN_CASES = [
    ("<b>x</b>", "x"),
    ("<é>x</é>", "x"),
    ("<b>x\ny</b>", "<b>x\ny</b>"),
    ("<b>x\ry</b>", "x\ry"),
    ("<҃>x</b>", "<҃>x</b>"),
    ("<bb>x</bb>", "<bb>x</bb>"),
    ("<b><i>x</i></b>", "<i>x</b>"),
    (" a\u001c", "a"),
    ("a\u0000b", "ab"),
    ("ΑΣ İ Ѿ", "ΑΣ İ Ѿ".lower()),
]


def test_clean_matches_python(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(CLEAN_CASES)], "i int, s string")
    got = {r.i: r.c for r in df.select("i", tx.clean_text("s").alias("c")).collect()}
    for i, (_, want) in enumerate(CLEAN_CASES):
        assert got[i] == want, (CLEAN_CASES[i], got[i])


def test_tokens_sentences_lines(spark):
    df = spark.createDataFrame([("Hello, wörld 42! Next one.  Last\nline ",)], "t string")
    r = df.select(tx.tokens("t").alias("tok"), tx.word_tokens("t").alias("w"),
                  tx.sentences("t").alias("s"), tx.endlines("t").alias("l")).first()
    assert r.tok == ["Hello", ",", "wörld", "42", "!", "Next", "one", ".", "Last", "line"]
    assert r.w == ["hello", "wörld", "next", "one", "last", "line"]
    assert r.s == ["Hello, wörld 42!", "Next one.", "Last\nline "]
    assert r.l == ["Hello, wörld 42! Next one.  Last", "line"]


def test_char_ngrams(spark):
    df = spark.createDataFrame([("abc",), ("",), ("a",)], "t string")
    rows = df.select(tx.char_ngrams(F.col("t")).alias("g")).collect()
    assert rows[0].g == ["a", "b", "c", "ab", "bc", "abc"]
    assert rows[1].g == []
    assert rows[2].g == ["a"]


def test_collapse_space(spark):
    df = spark.createDataFrame([("a  b\nc  d",)], "t string")
    assert df.select(tx.collapse_space("t").alias("c")).first().c == "a b\nc d"
