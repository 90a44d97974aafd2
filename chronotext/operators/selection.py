"""Feature scoring and selection on long-form features.

chi2 of a non-negative feature against a class label:
``sum_c (O_tc - E_tc)^2 / E_tc`` with ``O_tc`` the class sum of the feature,
``F_t`` its total and ``E_tc = p_c F_t``.  Since ``sum_c p_c = 1`` this is
``(sum_c O_tc^2 / p_c) / F_t - F_t``: only non-zero ``(term, class)`` sums
are needed, never a term x class grid.  A feature with ``F_t = 0`` scores
NaN and ranks last.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronotext.operators.ordering import running_index
from chronotext.session import stored

# Largest term list sent to every task (selected terms, column index); its
# size is known exactly after selection.  Above it, joins are shuffled.
BROADCAST_MAX_TERMS = 500_000
TOP_REPORT = 1000    # so many terms are merged in one task; more are selected by threshold
HISTOGRAM = 1024     # bins of a step towards the threshold


def keep_terms(feats: DataFrame, terms: DataFrame, n_terms: int, on=("fset", "term")) -> DataFrame:
    """Semi-join on a term list whose exact size ``n_terms`` is known."""
    small = F.broadcast(terms) if n_terms <= BROADCAST_MAX_TERMS else terms
    return feats.join(small, list(on), "left_semi")


def class_priors(labelled_docs: DataFrame, label: str = "label", weight: str | None = None) -> DataFrame:
    """``(label, n, p)`` over documents.  One row per class: bounded."""
    one = F.col(weight) if weight else F.lit(1)
    per = labelled_docs.groupBy(label).agg(F.sum(one).cast("double").alias("n"))
    return per.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))


def chi2_scores(features: DataFrame, labelled_docs: DataFrame, label: str = "label",
                weight: str | None = None) -> DataFrame:
    """``features(doc_id, [label], fset, term, value)`` -> ``(fset, term, chi2)``."""
    f = features if label in features.columns else features.join(
        labelled_docs.select("doc_id", label), "doc_id")
    v = F.col("value") * (F.col(weight) if weight else F.lit(1.0))
    priors = class_priors(labelled_docs, label, weight).select(label, "p")
    per_class = f.groupBy("fset", "term", label).agg(F.sum(v).alias("o"))
    per_class = per_class.join(F.broadcast(priors), label)   # one row per class
    agg = per_class.groupBy("fset", "term").agg(
        F.sum(F.col("o") * F.col("o") / F.col("p")).alias("s"), F.sum("o").alias("ft"))
    chi2 = F.when(F.col("ft") != 0, F.col("s") / F.col("ft") - F.col("ft")).otherwise(F.lit(float("nan")))
    return agg.select("fset", "term", chi2.alias("chi2"))


def curve_chi2_scores(steps: DataFrame, labelled_docs: DataFrame, upto: int, fset: str, prefix: str,
                      label: str = "label", weight: str | None = None) -> DataFrame:
    """``steps(doc_id, label, [weight], bin, step)`` -> ``(fset, term, bin, chi2)`` of every bin of the curves.

    Class sums of a curve are the running sums over bins of the class sums of
    its steps: a table of classes x bins, whatever the number of documents."""
    v = F.col("step") * (F.col(weight) if weight else F.lit(1.0))
    priors = class_priors(labelled_docs, label, weight).select(label, "p")
    sums = steps.groupBy(label, "bin").agg(F.sum(v).alias("rise"))
    grid = priors.withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(upto - 2))))
    upward = Window.partitionBy(label).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    risen = grid.join(sums, [label, "bin"], "left").select("bin", "p", F.sum(F.coalesce("rise", F.lit(0.0))).over(upward).alias("o"))
    cells = risen.groupBy("bin").agg(F.sum("o").alias("ft"), F.collect_list(F.struct("o", "p")).alias("cells"))
    part = lambda c: (c["o"] - c["p"] * F.col("ft")) * (c["o"] - c["p"] * F.col("ft")) / (c["p"] * F.col("ft"))
    chi2 = F.when(F.col("ft") != 0, F.aggregate("cells", F.lit(0.0), lambda a, c: a + part(c))).otherwise(F.lit(float("nan")))
    return cells.select(F.lit(fset).alias("fset"), F.concat(F.lit(prefix + "_"), F.col("bin").cast("string")).alias("term"), "bin",
                        chi2.alias("chi2"))


def keep_steps(steps: DataFrame, selected: DataFrame, upto: int) -> DataFrame:
    """Steps of curves cut down to ``selected(fset, term, bin)``: each moves to the next bin that is left.

    The running sum over the bins left is the curve there; steps behind the last one go."""
    bins = steps.sparkSession.range(1, upto - 1).select(F.col("id").cast("int").alias("bin"))
    ahead = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)  # one row a bin: bounded
    to = bins.join(selected, "bin", "left").select("bin", F.first("fset", ignorenulls=True).over(ahead).alias("fset"),
                                                   F.first("term", ignorenulls=True).over(ahead).alias("term"))
    carry = [c for c in steps.columns if c not in ("bin", "step")]
    return (steps.join(F.broadcast(to.where(F.col("term").isNotNull())), "bin").groupBy(*carry, "fset", "term")
            .agg(F.sum("step").alias("value")))


def k_for(n_features: int, k: int = 5000, k_ratio: float = 1.0) -> int:
    """Keep every feature below ``k``; otherwise ``round(n * k_ratio)``
    (round half to even)."""
    if n_features < k:
        return n_features
    return round(n_features * k_ratio)


def select_top_k(scores: DataFrame, k: int, score: str = "chi2", by: tuple = ("fset",)) -> DataFrame:
    """Top-k terms by score (NaN last); ties keep the greater term.

    A short report is a limit.  A longer selection finds the k-th score by
    histograms that narrow down on it, keeps what is above, and ranks only the
    terms that tie with it: no sort of all terms, and none in one task."""
    s = F.when(F.isnan(F.col(score)), F.lit(None)).otherwise(F.col(score).cast("double"))
    if k <= TOP_REPORT:
        return scores.orderBy(s.desc_nulls_last(), F.col("term").desc()).limit(k)
    scores = stored(scores.withColumn("_s", s), "scores")  # read again and again: sums must not be made anew
    n, low, high = scores.agg(F.count("_s"), F.min("_s"), F.max("_s")).first()  # chi2 is finite: high - low is too
    if n <= k:  # all that have a score, and of the others the greatest terms
        return scores.where("_s is not null").unionByName(_greatest_terms(scores.where("_s is null"), k - n)).drop("_s")
    need = k
    while low < high:
        place = F.least(F.floor((F.col("_s") - F.lit(low)) / F.lit(high - low) * F.lit(HISTOGRAM)), F.lit(HISTOGRAM - 1))
        bins = (scores.where(F.col("_s").between(low, high)).groupBy(place.alias("b"))
                .agg(F.count(F.lit(1)).alias("n"), F.min("_s").alias("low"), F.max("_s").alias("high")).collect())  # HISTOGRAM rows at most
        for one in sorted(bins, key=lambda r: -r["b"]):
            if one["n"] >= need:
                break
            need -= one["n"]
        low, high = one["low"], one["high"]  # narrower: the least and the greatest score are never in one bin
        if one["n"] == need:
            return scores.where(F.col("_s") >= low).drop("_s")
    return scores.where(F.col("_s") > low).unionByName(_greatest_terms(scores.where(F.col("_s") == low), need)).drop("_s")


def _greatest_terms(ties: DataFrame, n: int) -> DataFrame:
    """The ``n`` greatest terms, by a range sort over many tasks."""
    if n <= 0:
        return ties.limit(0)
    ranked = running_index(ties.withColumn("_all", F.lit(0)), ["_all"], [F.col("term").desc(), "fset"] if "fset" in ties.columns
                           else [F.col("term").desc()], "_rank")
    return ranked.where(F.col("_rank") < n).drop("_rank", "_all")


@dataclass
class FeatureSetReductor:
    """Extract a feature family, L2-normalise rows, keep the chi2 top-k.

    ``fit_transform`` learns the extractor's frozen tables and the selected
    terms; ``transform`` applies both to unseen documents (a join)."""

    extractor: object
    k: int = 5000
    k_ratio: float = 1.0
    normalize: bool = True
    label: str = "label"
    weight: str | None = None  # column of row multiplicities
    selected: DataFrame | None = field(default=None, repr=False)
    k_used: int | None = None
    _cached: list = field(default_factory=list, repr=False)

    def _reduce(self, feats: DataFrame) -> DataFrame:
        from chronotext.operators.terms import normalize_rows
        return normalize_rows(feats, "l2") if self.normalize else feats

    def fit_transform(self, docs: DataFrame, toks: DataFrame | None = None) -> DataFrame:
        feats = self._reduce(self._extract_fit(docs, toks))
        summed = feats
        if self.normalize and hasattr(self.extractor, "sums"):  # counted again for every read, inside its row
            plain = replace(self.extractor, norm=(*self.extractor.norms, "l2"))
            feats = plain.transform(docs, carry=self._carried())
            summed = plain.sums(docs, carry=self._carried())
        else:
            feats = summed = feats.persist()
            self._cached.append(feats)
        scores = chi2_scores(summed, docs, self.label, self.weight).persist()
        self._cached.append(scores)
        n_features = scores.count()
        self.k_used = k_for(n_features, self.k, self.k_ratio)
        self.selected = select_top_k(scores, self.k_used).select("fset", "term")
        return keep_terms(feats, self.selected, self.k_used)

    def transform(self, docs: DataFrame, toks: DataFrame | None = None) -> DataFrame:
        feats = self._reduce(self._extract(docs, toks))
        return keep_terms(feats, self.selected, self.k_used)

    def release(self) -> None:
        """Drop the stored features and scores of the fit, and the extractor's counts."""
        for df in self._cached:
            df.unpersist()
        self._cached = []
        if hasattr(self.extractor, "release"):
            self.extractor.release()

    def _carried(self) -> list:
        return [self.label, self.weight] if self.weight else [self.label]

    def _extract_fit(self, docs, toks):
        ex = self.extractor
        if hasattr(ex, "tag_col"):
            return ex.fit_transform(toks, docs, carry=self._carried())
        return ex.fit_transform(docs, carry=self._carried())

    def _extract(self, docs, toks):
        ex = self.extractor
        if hasattr(ex, "tag_col"):
            return ex.transform(toks, docs, carry=[self.label])
        return ex.transform(docs, carry=[self.label])


def hstack(blocks: list[DataFrame]) -> DataFrame:
    """Stack feature blocks: a union of long tables, each tagged by ``fset``
    (rows of oversampled copies keep their ``copy_no``)."""
    cols = ["doc_id"] + (["copy_no"] if all("copy_no" in b.columns for b in blocks) else []) + \
        ["fset", "term", "value"]
    out = blocks[0].select(*cols)
    for b in blocks[1:]:
        out = out.unionByName(b.select(*cols))
    return out


def feature_index(terms_by_set: DataFrame, set_order: list[str]) -> DataFrame:
    """Column numbers for the stacked matrix and per-set column ranges.

    ``terms_by_set(fset, term)`` -> ``(fset, term, col, start, end)``: sets
    in ``set_order``, terms in code-point order inside a set."""
    order = F.create_map(*[x for i, s in enumerate(set_order) for x in (F.lit(s), F.lit(i))])
    sizes = terms_by_set.groupBy("fset").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.withColumn("set_no", order[F.col("fset")])
    # one row per feature set: bounded
    w = Window.orderBy("set_no").rowsBetween(Window.unboundedPreceding, -1)
    ranges = sizes.withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).withColumn(
        "end", F.col("start") + F.col("n"))
    cols = running_index(terms_by_set.select("fset", "term"), ["fset"], ["term"], "pos")
    return cols.join(F.broadcast(ranges.select("fset", "start", "end")), "fset").select(
        "fset", "term", (F.col("start") + F.col("pos")).cast("long").alias("col"),
        F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
