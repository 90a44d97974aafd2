"""Token annotation table and segment-to-token joins.

``tokens(doc_id, sent_no, tok_no, start, end, text, pos, dep)`` is built
from the doc-partitioned corpus: the text is cut into pieces that cover
every character once (tokens and whitespace runs); one window pass over the
document's pieces gives char offsets and sentence numbers.  The input is
already hash-partitioned by ``doc_id``, so the windows add no shuffle.

The default tagger is a deterministic shape class (SQL ``CASE``); a real
language model plugs in through :func:`annotate_with`, which runs a user
function per Arrow batch (``mapInPandas``) and can load its model once per
Python worker.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.session import ship_package

TOKEN_SCHEMA = ("doc_id long, sent_no int, tok_no int, start int, end int, "
                "text string, pos string, dep string")


def tokens_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    pieces = docs.select("doc_id", F.posexplode(
        F.regexp_extract_all(F.col(text_col), F.lit(tx.PIECE), 0)).alias("p", "piece"))
    # one ordering for everything: (doc_id, p).  Sentence numbers only grow
    # with p, so per-sentence numbering is derived from running values over
    # the same window; Filter/Project keep the order, so it is sorted once.
    w = Window.partitionBy("doc_id").orderBy("p")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    is_ws = F.col("piece").rlike("^" + tx.WS)
    pieces = pieces.select(
        "doc_id", "p", "piece", is_ws.alias("is_ws"),
        (is_ws & F.lag("piece").over(w).isin(".", "!", "?")).cast("int").alias("brk"))
    pieces = pieces.select(
        "doc_id", "p", "piece", "is_ws",
        F.coalesce(F.sum(F.length("piece")).over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).cast("int").alias("start"),
        F.sum("brk").over(upto).cast("int").alias("sent_no"))
    pos = tx.shape_tag(F.col("piece"))
    toks = pieces.where(~F.col("is_ws")).select("doc_id", "p", "piece", "start", "sent_no", pos.alias("pos"))
    toks = toks.select(
        "*", F.row_number().over(w).alias("_k"),
        (F.coalesce(F.lag("sent_no").over(w), F.lit(-1)) != F.col("sent_no")).alias("_first"),
        F.lag("pos").over(w).alias("_prev_pos"))
    toks = toks.select("*", F.max(F.when(F.col("_first"), F.col("_k"))).over(upto).alias("_k0"))
    return toks.select(
        "doc_id", "sent_no", (F.col("_k") - F.col("_k0")).cast("int").alias("tok_no"),
        "start", (F.col("start") + F.length("piece")).cast("int").alias("end"),
        F.col("piece").alias("text"), "pos",
        F.concat(F.when(F.col("_first"), F.lit("ROOT")).otherwise(F.col("_prev_pos")), F.lit(">"), F.col("pos"))
        .alias("dep"))


def tags_by_sentence(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The tags of ``tokens_table`` as lists, ``(doc_id, sent_no, pos, dep)``, made inside the document's row.

    A sentence ends where the token table's does, so no window over pieces is needed."""
    tags = F.transform(tx.sentences(F.col(text_col)), lambda s: F.transform(tx.tokens(s), tx.shape_tag))
    rows = docs.select("doc_id", F.posexplode(tags).alias("sent_no", "pos")).where(F.size("pos") > 0)
    before = lambda i: F.when(i == 0, F.lit("ROOT")).otherwise(F.get("pos", i - 1))
    return rows.withColumn("dep", F.transform("pos", lambda t, i: F.concat(before(i), F.lit(">"), t)))


_LOADED: dict = {}


def _loaded(name: str, loader: Callable):
    """The worker's model of that name; another one takes its place."""
    if name not in _LOADED:
        _LOADED.clear()
        _LOADED[name] = loader()
    return _LOADED[name]


def annotate_with(docs: DataFrame, tagger: Callable | None = None, text_col: str = "text",
                  loader: Callable | None = None, name: str | None = None) -> DataFrame:
    """Run a user tagger per batch: ``tagger(pandas.DataFrame[doc_id, text])``
    returns rows of :data:`TOKEN_SCHEMA`.

    A model is given by a ``loader`` that returns the tagger: each Python
    worker calls it once and keeps what it returns under ``name`` for its next
    tasks.  A ``tagger`` is sent with every task as it is."""
    if (tagger is None) == (loader is None):
        raise ValueError("give a tagger or a loader")
    if loader is not None:
        ship_package(docs.sparkSession)
    name = name or f"{getattr(loader, '__module__', '')}.{getattr(loader, '__qualname__', repr(loader))}"

    def run(batches):
        tag = tagger if loader is None else _loaded(name, loader)
        for pdf in batches:
            yield tag(pdf)
    return docs.select("doc_id", F.col(text_col).alias("text")).mapInPandas(run, TOKEN_SCHEMA)


def attach_by_sentence(segments: DataFrame, toks: DataFrame) -> DataFrame:
    """Tokens of each fragment, by its sentence range (documented intent).

    Every fragment expands to its own sentence numbers (total rows = number
    of sentences), then an equi-join on ``(doc_id, sent_no)``: linear, no
    pairs of fragments and tokens are formed.  Whole documents take all
    their tokens."""
    frag = segments.where(F.col("kind") == "fragment").select(
        "doc_id", "seg_no", "kind", F.explode(F.sequence("first_sent", "last_sent")).alias("sent_no"))
    frag_toks = frag.join(toks, ["doc_id", "sent_no"])
    full = segments.where(F.col("kind") == "full").select("doc_id", "seg_no", "kind").join(toks, "doc_id")
    return full.unionByName(frag_toks)


def attach_whole_document(segments: DataFrame, toks: DataFrame) -> DataFrame:
    """Reference behaviour: every segment, fragment or not, gets the whole
    document's annotation.  Expressed as a per-document weight
    ``w = number of segments`` instead of duplicated token rows."""
    w = segments.groupBy("doc_id").agg(F.count(F.lit(1)).alias("w"))
    return toks.join(w, "doc_id")


def segment_char_range(segments: DataFrame, docs: DataFrame) -> DataFrame:
    """Reference locate rule: start = first occurrence of the fragment's first
    sentence in the parent text, end = start + length(fragment); not found ->
    dropped.  Adds ``seg_start``/``seg_end`` (0-based, end exclusive)."""
    seg = segments.withColumn("_first_sentence", F.element_at(tx.sentences(F.col("text")), 1))
    joined = seg.join(docs.select("doc_id", F.col("text").alias("_doc_text")), "doc_id")
    pos0 = F.expr("locate(_first_sentence, _doc_text)") - 1
    out = joined.withColumn("seg_start", pos0.cast("int")).drop("_first_sentence", "_doc_text")
    out = out.withColumn("seg_end", F.col("seg_start") + F.length("text"))
    return out.where(F.col("seg_start") >= 0)


def attach_by_char_range(ranged: DataFrame, toks: DataFrame, bucket: int = 4096) -> DataFrame:
    """Interval join: tokens overlapping ``[seg_start, seg_end)``.

    Both sides are cut into fixed char buckets; a pair meets only in the
    bucket holding the start of its overlap, so each pair is produced once
    and no segment is paired with the tokens of the whole document."""
    seg = ranged.select("doc_id", "seg_no", "kind", "seg_start", "seg_end", F.explode(F.sequence(
        F.floor(F.col("seg_start") / bucket), F.floor((F.col("seg_end") - 1) / bucket))).alias("b"))
    tk = toks.withColumn("b", F.explode(F.sequence(
        F.floor(F.col("start") / bucket), F.floor((F.col("end") - 1) / bucket))))
    j = seg.alias("s").join(tk.alias("t"), ["doc_id", "b"])
    j = j.where((F.col("t.start") < F.col("s.seg_end")) & (F.col("t.end") > F.col("s.seg_start")) &
                (F.col("b") == F.floor(F.greatest(F.col("s.seg_start"), F.col("t.start")) / bucket)))
    return j.select("doc_id", "s.seg_no", "s.kind", "t.sent_no", "t.tok_no", "t.start", "t.end",
                    "t.text", "t.pos", "t.dep")
