"""Stylometric feature families with ``fit`` / ``transform``.

Every family turns documents (and, for tag n-grams, the token table) into a
long table ``(doc_id, fset, term, value)``.  Fitting returns frozen
DataFrames (vocabulary, document count); ``transform`` on unseen documents
is a join against them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.functions import grams, rules
from chronotext.functions import text as tx
from chronotext.operators import histogram, terms
from chronotext.session import ship_package, stored

FEATURE_COLS = ["doc_id", "fset", "term", "value"]
VOCABULARY_SENT = 2_000_000   # character n-grams that a task holds: some 10 bytes each


def _long(weights: DataFrame, fset: str, carry=()) -> DataFrame:
    carry = [c for c in carry if c in weights.columns]
    return weights.select("doc_id", *carry, F.lit(fset).alias("fset"), "term",
                          F.col("value").cast("double").alias("value"))


@dataclass
class CharNGrams:
    """Character n-grams of the lower-cased text with whitespace runs
    collapsed, n in [n_min, n_max], min_df, raw tf, L1 rows (or no norm, or
    several, one after the other).

    A document is counted, cut down to the vocabulary and normalised inside its
    row, and made again for every read: that costs less than keeping, sorting or
    shuffling a row for each of its grams.  Up to ``VOCABULARY_SENT`` terms the
    vocabulary goes to every task; a larger one is joined with the counts."""

    n: tuple = (1, 3)
    min_df: int = 3
    norm: str | tuple | None = "l1"
    fset: str = "char_ngram"
    weight: str | None = None  # column of row multiplicities, counted in df
    vocab: DataFrame | None = field(default=None, repr=False)
    _sent: tuple | None = field(default=None, repr=False)

    @property
    def norms(self) -> tuple:
        return self.norm if isinstance(self.norm, tuple) else (self.norm,) if self.norm else ()

    def _carried(self, docs: DataFrame, carry) -> list:
        carry = [*carry, self.weight] if self.weight else carry
        return [c for c in dict.fromkeys(carry) if c in docs.columns and c != "doc_id"]

    def _texts(self, docs: DataFrame, carry) -> DataFrame:
        ship_package(docs.sparkSession)
        src = docs.select("doc_id", *carry, tx.collapse_space(F.lower(F.col("text"))).alias("_t"))
        return src.groupBy("doc_id", *carry).agg(F.collect_list("_t").alias("_t"))

    def counts(self, docs: DataFrame, carry=()) -> DataFrame:
        """(doc_id, [carry], term, c).  On doc-partitioned documents nothing is shuffled."""
        carry = self._carried(docs, carry)
        per_doc = self._texts(docs, carry)
        per_doc = per_doc.select("doc_id", *carry, grams.char_ngram_counts(F.col("_t"), self.n[0], self.n[1]).alias("_g"))
        return per_doc.select("doc_id", *carry, F.inline("_g"))

    def _groups(self, docs: DataFrame, carry) -> DataFrame:
        """``(doc_id, k, g)``: for every document its different carried values and the texts of each."""
        texts = self._texts(docs, carry)
        if not carry:
            return texts.select("doc_id", F.array(F.struct(F.lit(0).alias("_none"))).alias("k"), F.array("_t").alias("g"))
        own = texts.groupBy("doc_id").agg(F.collect_list(F.struct(F.struct(*carry).alias("k"), F.col("_t").alias("g"))).alias("_own"))
        return own.select("doc_id", F.col("_own.k").alias("k"), F.col("_own.g").alias("g"))

    def frequencies(self, docs: DataFrame, carry=()) -> DataFrame:
        """``(term, n)``: document frequencies in parts, to be added up by ``terms.fit_vocabulary``."""
        carry = self._carried(docs, carry)
        w = [F.col(self.weight).alias("w")] if self.weight else []
        return grams.document_frequencies(self._texts(docs, carry).select(F.array("_t").alias("g"), *w), self.n)

    def fit(self, docs: DataFrame, carry=()) -> "CharNGrams":
        # stored: its size is known then, so that a small one is sent and the texts stay where they are
        self.vocab = stored(terms.fit_vocabulary(self.frequencies(docs, carry), self.min_df, "n"), "vocabulary")
        return self

    def _known(self):
        """The broadcast terms of the vocabulary, or None if they are too many."""
        if self._sent is None or self._sent[0] is not self.vocab:
            self._sent = self.vocab, sent_terms(self.vocab)
        return self._sent[1]

    def weights(self, docs: DataFrame, carry=()) -> DataFrame:
        vocab = F.broadcast(self.vocab) if self._known() is not None else self.vocab
        w = terms.tf_idf(terms.apply_vocabulary(self.counts(docs, carry), vocab), 0, use_idf=False)
        for norm in self.norms:
            w = terms.normalize_rows(w, norm)
        return w

    def transform(self, docs: DataFrame, carry=()) -> DataFrame:
        held = self._known()
        if held is None:
            return _long(self.weights(docs, carry), self.fset, carry)
        own = self._carried(docs, carry)
        out = self._groups(docs, own).select("doc_id", "k", grams.char_ngram_values(F.col("g"), self.n, held, self.norms).alias("v"))
        out = out.select("doc_id", F.explode(F.arrays_zip("k", "v")).alias("z"))
        out = out.select("doc_id", *[F.col(f"z.k.{c}").alias(c) for c in own], F.inline("z.v"))
        return _long(out, self.fset, carry)

    def fit_transform(self, docs: DataFrame, carry=()) -> DataFrame:
        return self.fit(docs, carry).transform(docs, carry)

    def sums(self, docs: DataFrame, carry=()) -> DataFrame:
        """``(carry, fset, term, value, n)``: the values of ``transform`` added up by the carried columns, and how
        many there are, in parts: what sums over documents need of them."""
        held, own = self._known(), self._carried(docs, carry)
        if held is None:
            return self.transform(docs, own).drop("doc_id").withColumn("n", F.lit(1).cast("long"))
        out = grams.value_sums(self._groups(docs, own).select("k", "g"), self.n, held, self.norms)
        return out.select(*[F.col(f"k.{c}").alias(c) for c in own], F.lit(self.fset).alias("fset"), "term", "value", "n")

    def totals(self, docs: DataFrame) -> DataFrame:
        held = self._known()
        if held is None:
            return terms.term_totals(terms.apply_vocabulary(self.counts(docs), self.vocab))
        out = self._groups(docs, []).select("doc_id", grams.char_ngram_total(F.col("g"), self.n, held).alias("n_terms"))
        return out.where(F.col("n_terms").isNotNull())

    def found(self, docs: DataFrame, listed: DataFrame, name: str) -> DataFrame:
        """``(doc_id, name)``: how many of the ``listed(term)`` grams a document has; documents without any are left out."""
        held = sent_terms(listed)
        if held is None:
            return self.counts(docs).join(listed.select("term"), "term").groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
        out = self._groups(docs, []).select("doc_id", grams.char_ngram_total(F.col("g"), self.n, held, once=True).alias(name))
        return out.where(F.col(name).isNotNull())


def sent_terms(listed: DataFrame):
    """The terms of a stored list, broadcast to the tasks' Python; None if there are more than ``VOCABULARY_SENT``."""
    if listed.count() > VOCABULARY_SENT:
        return None
    held = listed.select("term").toArrow().column(0).cast("string").combine_chunks()
    return listed.sparkSession.sparkContext.broadcast(held)


@dataclass
class Punctuation:
    """Relative frequency of the 32 ASCII punctuation marks (single chars)."""

    norm: str | None = "l1"
    fset: str = "punctuation"

    def counts(self, docs: DataFrame, carry=()) -> DataFrame:
        # one character-class pass over the text (every mark escaped)
        marks = "[" + "".join("\\" + ch for ch in rules.PUNCTUATION) + "]"
        chars = F.regexp_extract_all(F.lower(F.col("text")), F.lit(marks), 0)
        return terms.count_terms(docs, chars, carry)

    def fit(self, docs: DataFrame, carry=()) -> "Punctuation":
        return self

    def transform(self, docs: DataFrame, carry=()) -> DataFrame:
        w = terms.tf_idf(self.counts(docs, carry), 0, use_idf=False)
        return _long(terms.normalize_rows(w, self.norm), self.fset, carry)

    fit_transform = transform

    def totals(self, docs: DataFrame) -> DataFrame:
        """Number of punctuation marks per document that has any."""
        return terms.term_totals(self.counts(docs))


@dataclass
class WordLengths:
    """Cumulative word-length distribution (Mendenhall curve), upto-2 bins."""

    upto: int = 25
    mode: str = "intended"
    fset: str = "word_length"

    def fit(self, docs: DataFrame, carry=()) -> "WordLengths":
        return self

    prefix = "word_length"

    def lengths(self, text):
        """The lengths of a text as an array."""
        return F.transform(tx.tokens(text), lambda t: F.length(t))

    def values(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.explode(self.lengths(F.col("text"))).alias("v"))

    def transform(self, docs: DataFrame, carry=()) -> DataFrame:
        out = histogram.ecdf(self.values(docs), docs, self.upto, self.prefix, self.mode, self.fset)
        return _carry(out.select(*FEATURE_COLS), docs, carry)

    fit_transform = transform


@dataclass
class SentenceLengths:
    """``intended``: cumulative distribution of sentence lengths in tokens.
    ``reference``: the word-length curve again over ``upto-2`` bins."""

    upto: int = 1000
    mode: str = "intended"
    fset: str = "sentence_length"

    def fit(self, docs: DataFrame, carry=()) -> "SentenceLengths":
        return self

    @property
    def prefix(self) -> str:
        return "word_length" if self.mode == "reference" else "sentence_length"

    def lengths(self, text):
        """The lengths of a text as an array."""
        if self.mode == "reference":
            return F.transform(tx.tokens(text), lambda t: F.length(t))
        return F.transform(tx.sentences(text), lambda s: F.size(tx.tokens(s)))

    def values(self, docs: DataFrame) -> DataFrame:
        return docs.select("doc_id", F.explode(self.lengths(F.col("text"))).alias("v"))

    def transform(self, docs: DataFrame, carry=()) -> DataFrame:
        out = histogram.ecdf(self.values(docs), docs, self.upto, self.prefix, self.mode, self.fset)
        return _carry(out.select(*FEATURE_COLS), docs, carry)

    fit_transform = transform


def _carry(features: DataFrame, docs: DataFrame, carry) -> DataFrame:
    carry = [c for c in carry if c in docs.columns and c != "doc_id"]
    if not carry:
        return features
    return features.join(docs.select("doc_id", *carry), "doc_id")


def tag_ngrams(toks: DataFrame, tag_col: str = "pos", n: tuple = (1, 3)) -> DataFrame:
    """Tag n-grams inside each sentence: ``(doc_id, term)`` per occurrence.
    Empty tags read as ``Unk``; grams joined with ``-``; n from n[0] to n[1]
    inclusive; never across a sentence boundary."""
    w = Window.partitionBy("doc_id", "sent_no").orderBy("tok_no")
    tag = F.when(F.coalesce(F.col(tag_col), F.lit("")) == "", F.lit(rules.UNKNOWN_TAG)).otherwise(F.col(tag_col))
    t = toks.select("doc_id", "sent_no", "tok_no", tag.alias("tag"))
    nexts = [F.col("tag")] + [F.lead("tag", k).over(w) for k in range(1, n[1])]
    t = t.select("doc_id", F.array(*nexts).alias("nx"))
    grams = [F.when(F.element_at("nx", k).isNotNull(),
                    F.array_join(F.slice("nx", 1, k), rules.NGRAM_JOINER)) for k in range(n[0], n[1] + 1)]
    return t.select("doc_id", F.explode(F.array(*grams)).alias("term")).where(F.col("term").isNotNull())


@dataclass
class TagNGrams:
    """POS (``tag_col='pos'``) or dependency (``'dep'``) n-grams, tf-idf."""

    tag_col: str = "pos"
    n: tuple = (1, 3)
    use_idf: bool = True
    sublinear_tf: bool = True
    norm: str | None = "l2"
    min_df: int = 1
    fset: str | None = None
    weight: str | None = None  # column of row multiplicities, counted in df and N
    vocab: DataFrame | None = field(default=None, repr=False)
    n_docs: int | None = None

    @property
    def name(self) -> str:
        return self.fset or f"{self.tag_col}_ngram"

    _memo: tuple | None = field(default=None, repr=False)

    def _lists(self, toks: DataFrame) -> DataFrame:
        """``(doc_id, items)``, ``items`` lists of ``(term, c)``: counted in the document's row and stored once, so that no
        row of a gram is sorted, shuffled or held in memory."""
        if not (self._memo and self._memo[0] is toks):
            ship_package(toks.sparkSession)
            tag = F.when(F.coalesce(F.col(self.tag_col), F.lit("")) == "", F.lit(rules.UNKNOWN_TAG)).otherwise(F.col(self.tag_col))
            own = toks.groupBy("doc_id").agg(F.collect_list(F.struct("sent_no", "tok_no", tag.alias("tag"))).alias("_s"))
            items = grams.row_counts(F.col("_s"), grams.row_slices("tokens", self.n, rules.NGRAM_JOINER))
            self._memo = toks, stored(own.select("doc_id", items.alias("items")), "tag-counts")
        return self._memo[1]

    def counts(self, toks: DataFrame) -> DataFrame:
        return self._lists(toks).select("doc_id", F.inline("items"))

    def release(self) -> None:
        """Forget the stored counts (they are made again when needed)."""
        self._memo = None

    def fit(self, toks: DataFrame, docs: DataFrame) -> "TagNGrams":
        counts, n = self.counts(toks), F.count(F.lit(1))
        if self.weight:
            counts, n = counts.join(docs.select("doc_id", self.weight), "doc_id"), F.sum(self.weight)
        self.vocab = stored(terms.fit_vocabulary(counts, self.min_df, self.weight), "vocabulary")
        self.n_docs = docs.agg(n).first()[0] if self.n_docs is None else self.n_docs
        return self

    def _known(self):
        """The broadcast terms of the vocabulary and their idf, or None if they are too many."""
        if self.vocab.count() > VOCABULARY_SENT:
            return None
        listed = self.vocab.toArrow()
        factor = np.ones(listed.num_rows)
        if self.use_idf:
            factor = np.log((self.n_docs + 1.0) / (listed.column("df").to_numpy() + 1.0)) + 1.0
        return self.vocab.sparkSession.sparkContext.broadcast((listed.column("term").cast("string").combine_chunks(), factor))

    def transform(self, toks: DataFrame, docs: DataFrame | None = None, carry=()) -> DataFrame:
        held = self._known()
        if held is None:
            inv = terms.apply_vocabulary(self.counts(toks), self.vocab)
            w = terms.tf_idf(inv, self.n_docs, self.use_idf, self.sublinear_tf)
            w = terms.normalize_rows(w, self.norm)
        else:
            values = grams.listed_values(F.col("items"), held, self.sublinear_tf, self.norm)
            w = self._lists(toks).select("doc_id", values.alias("v")).select("doc_id", F.inline("v"))
        out = _long(w, self.name)
        return _carry(out, docs, carry) if docs is not None else out

    def fit_transform(self, toks: DataFrame, docs: DataFrame, carry=()) -> DataFrame:
        return self.fit(toks, docs).transform(toks, docs, carry)

    def totals(self, toks: DataFrame) -> DataFrame:
        """Number of fitted-vocabulary tag n-grams per document."""
        vocab = F.broadcast(self.vocab) if self._known() is not None else self.vocab
        return terms.term_totals(terms.apply_vocabulary(self.counts(toks), vocab))


def feature_names(upto: int, prefix: str = "word_length") -> DataFrame:
    """Names ``prefix_i`` of a histogram family, one per bin (i = 1..upto-2)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    return spark.range(1, upto - 1).select(
        F.col("id").cast("int").alias("col"), F.concat(F.lit(prefix + "_"), F.col("id").cast("string")).alias("name"))


def function_word_counts(docs: DataFrame, words: list[str]) -> DataFrame:
    """Occurrences of listed function words per document (semi-join of the
    word tokens with the fixed word list; the list is bounded and broadcast)."""
    spark = docs.sparkSession
    table = spark.createDataFrame([(w,) for w in words], "term string")
    toks = docs.select("doc_id", F.explode(tx.word_tokens(F.col("text"))).alias("term"))
    hits = toks.join(F.broadcast(table), "term", "left_semi")
    return hits.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("c"))
