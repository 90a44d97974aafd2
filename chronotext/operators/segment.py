"""Segmentation: sentences, lines, short-sentence merge, token windows.

Every step is an array expression evaluated inside the document's row
(``aggregate`` folds, ``filter``, ``transform``), so segmentation adds no
shuffle; the only shuffle is the final running name index.

Fragments are ``struct<text, n_tok, first, last>``: the text, its number of
raw tokens, and the first/last sentence (or line) number it covers, so a
fragment can be joined back to the token table by sentence range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotext.functions import text as tx
from chronotext.operators.ordering import running_index

FRAG = "struct<text:string,n_tok:int,first:int,last:int>"
VALID_POLICIES = ("by_endline", "by_sentence")


def _frag(text: Column, n_tok: Column, first: Column, last: Column) -> Column:
    return F.struct(text.alias("text"), n_tok.cast("int").alias("n_tok"),
                    first.cast("int").alias("first"), last.cast("int").alias("last"))


def _units(parts: Column, with_words: bool) -> Column:
    """array<string> -> array<struct<text, n_words, n_tok, idx>>."""
    def unit(s, i):
        fields = [s.alias("text"), F.size(tx.tokens(s)).alias("n_tok"), i.alias("idx")]
        if with_words:
            fields.insert(1, tx.n_word_tokens(s).alias("n_words"))
        return F.struct(*fields)
    return F.transform(parts, unit)


def _join(a: Column, b: Column) -> Column:
    return F.when(a.isNull(), b).otherwise(F.concat(a, F.lit(" "), b))


def merge_short_sentences(sent_units: Column, min_tokens: int = 8,
                          mode: str = "intended") -> Column:
    """Merge sentences with fewer than ``min_tokens`` word tokens forward; a
    short tail joins the previous sentence.  If the whole text never reaches
    ``min_tokens``: ``reference`` yields no sentence, ``intended`` keeps it."""
    init = F.struct(
        F.array().cast(f"array<{FRAG}>").alias("done"),
        F.lit(None).cast("string").alias("buf"), F.lit(0).alias("bw"),
        F.lit(0).alias("bt"), F.lit(None).cast("int").alias("bf"), F.lit(None).cast("int").alias("bl"))

    def step(acc, x):
        buf = _join(acc["buf"], x["text"])
        bw = acc["bw"] + x["n_words"]
        bt = acc["bt"] + x["n_tok"]
        bf = F.coalesce(acc["bf"], x["idx"])
        full = bw >= F.lit(min_tokens)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(_frag(buf, bt, bf, x["idx"])))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit(None).cast("string")).otherwise(buf).alias("buf"),
            F.when(full, F.lit(0)).otherwise(bw).alias("bw"),
            F.when(full, F.lit(0)).otherwise(bt).alias("bt"),
            F.when(full, F.lit(None).cast("int")).otherwise(bf).alias("bf"),
            x["idx"].alias("bl"))

    def finish(acc):
        done, n = acc["done"], F.size(acc["done"])
        last = F.element_at(done, -1)
        merged = F.concat(F.slice(done, 1, n - 1), F.array(_frag(
            F.concat(last["text"], F.lit(" "), acc["buf"]), last["n_tok"] + acc["bt"], last["first"], acc["bl"])))
        alone = (F.array(_frag(acc["buf"], acc["bt"], acc["bf"], acc["bl"])) if mode == "intended"
                 else F.array().cast(f"array<{FRAG}>"))
        return (F.when(acc["buf"].isNull(), done)
                .when(n > 0, merged)
                .otherwise(alone))

    return F.aggregate(sent_units, init, step, finish)


def windows_reference(frags: Column, n: int) -> Column:
    """Reference window rule: fragments with >= n tokens stay as they are, in
    order; all shorter fragments are joined into one segment, emitted last."""
    def cut(frags):
        long = F.filter(frags, lambda f: f["n_tok"] >= n)
        short = F.filter(frags, lambda f: f["n_tok"] < n)
        rest = _frag(F.array_join(F.transform(short, lambda f: f["text"]), " "),
                     F.aggregate(short, F.lit(0), lambda a, f: a + f["n_tok"]),
                     F.array_min(F.transform(short, lambda f: f["first"])),
                     F.array_max(F.transform(short, lambda f: f["last"])))
        return F.when(F.size(short) > 0, F.concat(long, F.array(rest))).otherwise(long)

    return F.transform(F.array(frags), cut)[0]  # an argument is made once, however often it is read


def windows_greedy(frags: Column, n: int) -> Column:
    """Documented window rule: append fragments to a running batch, emit the
    batch once it holds >= n tokens, keep the tail; order preserved."""
    init = F.struct(F.array().cast(f"array<{FRAG}>").alias("done"),
                    F.lit(None).cast("string").alias("buf"), F.lit(0).alias("bt"),
                    F.lit(None).cast("int").alias("bf"), F.lit(None).cast("int").alias("bl"))

    def step(acc, f):
        buf = _join(acc["buf"], f["text"])
        bt = acc["bt"] + f["n_tok"]
        bf = F.coalesce(acc["bf"], f["first"])
        full = bt >= F.lit(n)
        return F.struct(
            F.when(full, F.concat(acc["done"], F.array(_frag(buf, bt, bf, f["last"])))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.lit(None).cast("string")).otherwise(buf).alias("buf"),
            F.when(full, F.lit(0)).otherwise(bt).alias("bt"),
            F.when(full, F.lit(None).cast("int")).otherwise(bf).alias("bf"),
            f["last"].alias("bl"))

    def finish(acc):
        tail = F.array(_frag(acc["buf"], acc["bt"], acc["bf"], acc["bl"]))
        return F.when(acc["buf"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], tail))

    return F.aggregate(frags, init, step, finish)


def sentence_units(text: Column) -> Column:
    return _units(tx.sentences(text), with_words=True)


def line_fragments(text: Column) -> Column:
    units = _units(tx.endlines(text), with_words=False)
    return F.transform(units, lambda u: _frag(u["text"], u["n_tok"], u["idx"], u["idx"]))


@dataclass
class Segmentation:
    """Split documents into fragments; ``transform`` returns one table
    ``(doc_id, kind, seg_no, text, n_tok, first_sent, last_sent, ...)`` with
    whole documents (``kind='full'``, if ``keep_full``) and fragments."""

    split_policy: str = "by_sentence"
    tokens_per_fragment: int = 500
    min_tokens: int = 8
    keep_full: bool = True
    mode: str = "intended"

    def __post_init__(self):
        if self.split_policy not in VALID_POLICIES:
            raise ValueError(f"split_policy is {self.split_policy!r}; it can be {', '.join(sorted(VALID_POLICIES))}")
        if self.mode not in ("intended", "reference"):
            raise ValueError("mode must be 'intended' or 'reference'")

    def fit(self, docs: DataFrame, y=None) -> "Segmentation":
        return self

    def fragments(self, text: Column) -> Column:
        if self.split_policy == "by_endline":
            frags = line_fragments(text)
        else:
            frags = merge_short_sentences(sentence_units(text), self.min_tokens, self.mode)
        if self.mode == "reference":
            return windows_reference(frags, self.tokens_per_fragment)
        return windows_greedy(frags, self.tokens_per_fragment)

    def transform(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        keep = [c for c in (keep or []) if c in docs.columns]
        frag = (docs.select("doc_id", *keep, F.posexplode(self.fragments(F.col("text"))).alias("seg_no", "f"))
                .select("doc_id", *keep, F.lit("fragment").alias("kind"), F.col("seg_no").cast("int").alias("seg_no"),
                        F.col("f.text").alias("text"), F.col("f.n_tok").alias("n_tok"),
                        F.col("f.first").alias("first_sent"), F.col("f.last").alias("last_sent")))
        if not self.keep_full and self.mode == "reference":
            # the reference zips documents with an empty group list: nothing
            return frag.limit(0)
        if not self.keep_full:
            return frag
        full = docs.select("doc_id", *keep, F.lit("full").alias("kind"), F.lit(0).alias("seg_no"),
                           F.col("text"), F.size(tx.tokens(F.col("text"))).alias("n_tok"),
                           F.lit(None).cast("int").alias("first_sent"), F.lit(None).cast("int").alias("last_sent"))
        return full.unionByName(frag)

    def fit_transform(self, docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
        return self.fit(docs).transform(docs, keep)


def segment_index(segments: DataFrame, name_col: str = "filename", out: str = "group") -> DataFrame:
    """Running per-name suffix: whole documents first, then fragments, in
    document and fragment order; ``group = name || '_' || k``.

    Rows are sorted and checkpointed with all their columns: pass only those
    that are wanted (the index needs no text)."""
    kind_rank = F.when(F.col("kind") == "full", 0).otherwise(1)
    ranked = running_index(segments.withColumn("_kind_rank", kind_rank), [name_col],
                           ["_kind_rank", "doc_id", "seg_no"], name="name_idx")
    return ranked.withColumn(out, F.concat_ws("_", F.col(name_col), F.col("name_idx").cast("string"))).drop("_kind_rank")
