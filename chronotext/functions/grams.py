"""Character n-grams of one document's texts, counted in Arrow batches.

A text is cut into grams and counted where it is read, so that a row for every
distinct gram of a document leaves the task and not one for every occurrence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = "array<struct<term:string,c:bigint>>"
TAG_END = "\x1f"     # between the tags of a sentence that travel as one string
SLICE = 1 << 20      # characters that are counted at a time
TABLE = 1 << 24      # codes below this are told apart by a table, others by sorting


def _dense(codes: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in rising order, and the place of each code among them."""
    if span > min(TABLE, 16 * len(codes) + 4096):
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(span, dtype=bool)
    seen[codes] = True
    distinct = np.flatnonzero(seen)
    place = np.zeros(span, dtype=np.int64)
    place[distinct] = np.arange(len(distinct))
    return distinct, place[codes]


def _by_length(texts: list[str], owners: np.ndarray, n_min: int, n_max: int):
    """For every length ``(grams, owner, place of the gram, count)``, sorted by owner; ``owners`` rise."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    alphabet, codes = _dense(points, int(points.max(initial=0)) + 1)
    return _runs(codes, sizes, [chr(p) for p in alphabet.tolist()], owners, n_min, n_max)


def _runs(codes: np.ndarray, sizes: np.ndarray, names: list[str], owners: np.ndarray, n_min: int, n_max: int, joiner: str = ""):
    """The same of sequences of ``sizes`` items; ``codes`` are the items' places in ``names``."""
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # items up to the sequence's end
    owner = np.repeat(owners, sizes)
    known, grams = names, codes  # the grams of the length before
    for n in range(1, n_max + 1):
        if n > 1:
            raw = grams[:len(codes) - n + 1] * len(names) + codes[n - 1:]
            whole = left[:len(raw)] >= n
            distinct, at = _dense(raw[whole], len(known) * len(names))
            known = [known[g] + joiner + names[c] for g, c in zip((distinct // len(names)).tolist(), (distinct % len(names)).tolist(), strict=True)]
            grams = np.zeros(len(raw), dtype=np.int64)
            grams[whole] = at
            numbers = owner[:len(raw)][whole] * max(1, len(known)) + at
        else:
            numbers = owner * max(1, len(known)) + codes
        if n < n_min:
            continue
        numbers.sort()
        first = np.flatnonzero(np.diff(numbers, prepend=-1))
        counts = np.diff(first, append=len(numbers))
        mine, gram = np.divmod(numbers[first], max(1, len(known)))
        yield known, mine, gram, counts


def count_grams(texts: list[str], owners: np.ndarray, n_min: int, n_max: int):
    """``(owner, term, count)``, sorted by owner, of the n-grams (code points) of ``texts``; ``owners`` rise."""
    known, mine, gram, counts = _in_order(_by_length(texts, owners, n_min, n_max))
    return mine, known.take(pa.array(gram)), pa.array(counts.astype(np.int64))


def _in_order(lengths, vocab: pa.Array | None = None):
    """``(grams, owner, place of the gram, count)`` of all lengths, sorted by owner; with ``vocab`` only its grams."""
    known, mine, gram, counts = zip(*lengths, strict=True)
    gram = np.concatenate([g + lo for g, lo in zip(gram, np.cumsum([0, *map(len, known)]), strict=False)])
    mine, counts = np.concatenate(mine), np.concatenate(counts)
    known = pa.concat_arrays([pa.array(k, type=pa.string()) for k in known])
    if vocab is not None:
        kept = pc.is_in(known, value_set=vocab).to_numpy(zero_copy_only=False)[gram]
        mine, gram, counts = mine[kept], gram[kept], counts[kept]
    order = np.argsort(mine, kind="stable")
    return known, mine[order], gram[order], counts[order]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(groups: pa.Array, n_min: int, n_max: int, vocab: pa.Array | None):
    """Counts of ``groups``, lists of lists of texts, a slice of rows at a time: ``(row, grams, group, place of the
    gram, count)``, sorted by group; groups are numbered through, a row's groups are in one slice."""
    lists = groups.flatten()
    row = np.repeat(np.arange(len(groups)), _sizes(groups))
    group = np.repeat(np.arange(len(lists)), _sizes(lists))
    texts = [t or "" for t in lists.flatten().to_pylist()]
    upto = np.cumsum([0, *map(len, texts)])
    own = row[group]
    begins = upto[np.searchsorted(own, own)]  # characters before the text's row
    cuts = np.flatnonzero(np.diff(begins // SLICE)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(texts)], strict=True):
        if upto[hi] > upto[lo]:
            known, mine, gram, counts = _in_order(_by_length(texts[lo:hi], group[lo:hi], n_min, n_max), vocab)
            yield row[mine], known, mine, gram, counts


def _normed(row: np.ndarray, counts: np.ndarray, norms: tuple) -> np.ndarray:
    """Values of rows after their L1 and L2 norms, one after the other."""
    row, value = row - row[:1].sum(), counts.astype(np.float64)
    for norm in norms:
        total = np.bincount(row, np.abs(value)) if norm == "l1" else np.sqrt(np.bincount(row, value * value))
        value = value / total[row]
    return value


def weighted(groups: pa.Array, n_min: int, n_max: int, vocab: pa.Array, norms: tuple) -> pa.Array:
    """For every group its list of ``(term, value)``: the grams of ``vocab`` with counts normalised over the row's groups."""
    sizes, parts = np.zeros(int(_sizes(groups).sum()), dtype=np.int64), []
    for row, known, mine, gram, counts in _slices(groups, n_min, n_max, vocab):
        sizes += np.bincount(mine, minlength=len(sizes))
        parts.append(pa.StructArray.from_arrays([known.take(pa.array(gram)), pa.array(_normed(row, counts, norms))], names=["term", "value"]))
    values = pa.concat_arrays(parts) if parts else pa.array([], type=pa.struct([("term", pa.string()), ("value", pa.float64())]))
    inner = pa.ListArray.from_arrays(_offsets(sizes), values)
    return pa.ListArray.from_arrays(_offsets(_sizes(groups)), inner)


def _offsets(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))


def totals(groups: pa.Array, n_min: int, n_max: int, vocab: pa.Array, once: bool) -> pa.Array:
    """Occurrences of the grams of ``vocab`` in every row, or with ``once`` the number of those that occur; null for none."""
    out = np.zeros(len(groups), dtype=np.int64)
    for row, _, _, _, counts in _slices(groups, n_min, n_max, vocab):
        np.add.at(out, row, 1 if once else counts)
    return pa.array(out, mask=out == 0)


def frequencies(groups: pa.Array, weights: np.ndarray | None, n_min: int, n_max: int):
    """``(terms, groups that have them)``, a slice at a time; a group counts as its weight."""
    for _, known, mine, gram, _ in _slices(groups, n_min, n_max, None):
        yield known, (np.bincount(gram, minlength=len(known)) if weights is None
                      else np.bincount(gram, weights[mine], minlength=len(known)))


def summed(groups: pa.Array, kinds: list, n_min: int, n_max: int, vocab: pa.Array, norms: tuple):
    """``(kind, terms, values, groups)`` added up over the groups of a kind, a slice at a time."""
    number: dict = {}
    codes = np.array([number.setdefault(k, len(number)) for k in kinds], dtype=np.int64)
    names = list(number)
    for row, known, mine, gram, counts in _slices(groups, n_min, n_max, vocab):
        value, kind = _normed(row, counts, norms), codes[mine]
        order = np.argsort(kind, kind="stable")  # kinds may be many: no table of kinds and grams
        value, gram = value[order], gram[order]
        ends = np.cumsum(np.bincount(kind, minlength=len(names)))
        for k, (lo, hi) in enumerate(zip([0, *ends[:-1]], ends, strict=True)):
            if hi > lo:
                n = np.bincount(gram[lo:hi], minlength=len(known))
                there = np.flatnonzero(n)
                yield names[k], known.take(pa.array(there)), np.bincount(gram[lo:hi], value[lo:hi], minlength=len(known))[there], n[there]


def counted(texts: pa.Array, n_min: int, n_max: int) -> pa.Array:
    """One list of ``(term, c)`` for every list of texts; null texts count as none."""
    sizes, parts, held, owners, chars = np.zeros(len(texts), dtype=np.int64), [], [], [], 0

    def close():
        mine, term, c = count_grams(held, np.array(owners, dtype=np.int64), n_min, n_max)
        sizes[:] += np.bincount(mine, minlength=len(sizes))
        parts.append(pa.StructArray.from_arrays([term, c], names=["term", "c"]))
        held.clear(), owners.clear()

    for k in range(len(texts)):  # a row's texts stay in one slice
        for t in texts[k].as_py() or ():
            if t:
                held.append(t)
                owners.append(k)
                chars += len(t)
        if chars >= SLICE:
            close()
            chars = 0
    if held:
        close()
    values = pa.concat_arrays(parts) if parts else pa.array([], type=pa.struct([("term", pa.string()), ("c", pa.int64())]))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)


def _called_once(function, kind: str):
    """An Arrow function that the optimiser does not call twice: a filter of what it gives (nulls, or lists without an item
    before they are written out) would be moved below it, with a call of its own."""
    return F.arrow_udf(function, kind).asNondeterministic()


def char_ngram_counts(texts: Column, n_min: int = 1, n_max: int = 3) -> Column:
    """Counts of all character n-grams (code points), n_min..n_max, of an array of strings."""
    def grams(t: pa.Array) -> pa.Array:
        return counted(t, n_min, n_max)

    return _called_once(grams, COUNTS)(texts)


def char_ngram_values(groups: Column, n: tuple, held, norms: tuple) -> Column:
    """``(term, value)`` lists of an array of arrays of strings; ``held`` broadcasts the vocabulary."""
    def values(g: pa.Array) -> pa.Array:
        return weighted(g, *n, held.value, norms)

    return _called_once(values, "array<array<struct<term:string,value:double>>>")(groups)


def char_ngram_total(groups: Column, n: tuple, held, once: bool = False) -> Column:
    """Number of n-grams of an array of arrays of strings that the broadcast vocabulary has; null for none."""
    def total(g: pa.Array) -> pa.Array:
        return totals(g, *n, held.value, once)

    return _called_once(total, "bigint")(groups)


def document_frequencies(docs: DataFrame, n: tuple) -> DataFrame:
    """``docs(g, [w])`` -> ``(term, n)``: partial document frequencies, added up in every slice of texts."""
    def run(batches):
        for b in batches:
            w = b.column("w").to_numpy(zero_copy_only=False).astype(np.float64) if "w" in b.schema.names else None
            if w is not None:  # one weight a row
                w = np.repeat(np.nan_to_num(w), _sizes(b.column("g")))
            for terms, found in frequencies(b.column("g"), w, *n):
                yield pa.RecordBatch.from_arrays([terms, pa.array(found)], names=["term", "n"])

    return docs.mapInArrow(run, f"term string, n {'double' if 'w' in docs.columns else 'bigint'}")


def value_sums(docs: DataFrame, n: tuple, held, norms: tuple) -> DataFrame:
    """``docs(g, k)`` -> ``(k, term, value, n)``: values added up by kind, and how many there are, in every slice of texts.

    ``k`` has a struct for every group of texts in ``g``."""
    def run(batches):
        for b in batches:
            kinds = b.column("k").flatten()
            for k, terms, value, found in summed(b.column("g"), [tuple(x.items()) for x in kinds.to_pylist()], *n, held.value, norms):
                same = pa.array([dict(k)], type=kinds.type).take(pa.array(np.zeros(len(terms), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([same, terms, pa.array(value), pa.array(found)], names=["k", "term", "value", "n"])

    kind = docs.schema["k"].dataType.elementType.simpleString()
    return docs.mapInArrow(run, f"k {kind}, term string, value double, n bigint")


def _sentence_slices(sentences: pa.Array, n_min: int, n_max: int, vocab: pa.Array | None, joiner: str):
    """As ``_slices``, of the tags of every row's sentences, lists of ``(sent_no, tags)``, the tags joined by ``TAG_END``.

    A sentence that a row has several times is one, each tag as often in a row."""
    flat = sentences.flatten()
    row = np.repeat(np.arange(len(sentences)), _sizes(sentences))
    number, tags = flat.field(0).to_numpy(zero_copy_only=False), pc.split_pattern(flat.field(1), TAG_END)
    sizes = _sizes(tags)
    names = tags.flatten().dictionary_encode()
    codes, names = names.indices.to_numpy(zero_copy_only=False).astype(np.int64), names.dictionary.to_pylist()
    order = np.lexsort((number, row))
    same = (np.diff(row[order]) == 0) & (np.diff(number[order]) == 0)
    if same.any():
        merged = np.zeros(len(row), dtype=np.int64)
        merged[order] = np.cumsum(np.concatenate([[0], ~same]))
        at = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        whole = np.repeat(merged, sizes)
        codes = codes[np.lexsort((at, whole))]
        sizes = np.bincount(merged, sizes).astype(np.int64)
        row = row[order][np.concatenate([[True], ~same])]
    upto = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.flatnonzero(np.diff(upto[np.searchsorted(row, row)] // SLICE)) + 1  # a row's sentences stay in one slice
    for lo, hi in zip([0, *cuts], [*cuts, len(row)], strict=True):
        if upto[hi] > upto[lo]:
            runs = _runs(codes[upto[lo]:upto[hi]], sizes[lo:hi], names, row[lo:hi], n_min, n_max, joiner)
            known, mine, gram, counts = _in_order(runs, vocab)
            yield mine, known, mine, gram, counts


def _token_slices(tokens: pa.Array, n_min: int, n_max: int, vocab: pa.Array | None, joiner: str):
    """As ``_slices``, of every row's tokens, lists of ``(sent_no, tok_no, tag)`` in any order."""
    sizes = _sizes(tokens)
    upto = np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.flatnonzero(np.diff(upto[:-1] // SLICE)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(sizes)], strict=True):
        if upto[hi] == upto[lo]:
            continue
        flat = tokens.slice(lo, hi - lo).flatten()
        sent, place = (pc.fill_null(flat.field(k), -1).to_numpy(zero_copy_only=False) for k in (0, 1))
        tags = flat.field(2).dictionary_encode()
        row = np.repeat(np.arange(lo, hi), sizes[lo:hi])
        order = np.lexsort((place, sent, row))
        row, sent = row[order], sent[order]
        first = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(sent) != 0)))
        codes = tags.indices.to_numpy(zero_copy_only=False).astype(np.int64)[order]
        runs = _runs(codes, np.diff(np.append(first, len(row))), tags.dictionary.to_pylist(), row[first], n_min, n_max, joiner)
        known, mine, gram, counts = _in_order(runs, vocab)
        yield mine, known, mine, gram, counts


def row_slices(kind: str, n: tuple, joiner: str = ""):
    """Cuts an Arrow array of every row's texts (``chars``), sentences (``tags``) or tokens (``tokens``) into counted slices."""
    def chars(col: pa.Array, vocab: pa.Array | None):
        one = pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1, dtype=np.int32)), col)  # one group a row
        return _slices(one, *n, vocab)

    def tags(col: pa.Array, vocab: pa.Array | None):
        return _sentence_slices(col, *n, vocab, joiner)

    def tokens(col: pa.Array, vocab: pa.Array | None):
        return _token_slices(col, *n, vocab, joiner)

    return {"chars": chars, "tags": tags, "tokens": tokens}[kind]


def row_frequencies(rows: DataFrame, cut) -> DataFrame:
    """``rows(g, w)`` -> ``(term, n)``: weights of the rows that have a term, added up in every slice."""
    def run(batches):
        for b in batches:
            w = np.nan_to_num(b.column("w").to_numpy(zero_copy_only=False).astype(np.float64))
            for _, known, mine, gram, _ in cut(b.column("g"), None):
                yield pa.RecordBatch.from_arrays([known, pa.array(np.bincount(gram, w[mine], minlength=len(known)))], names=["term", "n"])

    return rows.mapInArrow(run, "term string, n double")


def row_counts(col: Column, cut, held=None) -> Column:
    """Lists of ``(t, c)``, ``t`` the place of the gram in the broadcast vocabulary; without one, of ``(term, c)`` of all grams."""
    def counts(c: pa.Array) -> pa.Array:
        vocab = held.value if held is not None else None
        sizes, parts = np.zeros(len(c), dtype=np.int64), []
        for row, known, _, gram, n in cut(c, vocab):
            sizes += np.bincount(row, minlength=len(sizes))
            if vocab is None:
                name = known.take(pa.array(gram))
            else:
                name = pa.array(pc.index_in(known, value_set=vocab).fill_null(-1).to_numpy(zero_copy_only=False)[gram], pa.int32())
            parts.append(pa.StructArray.from_arrays([name, pa.array(n.astype(np.int64))], names=["term" if vocab is None else "t", "c"]))
        kind = pa.struct([("term", pa.string()) if vocab is None else ("t", pa.int32()), ("c", pa.int64())])
        return pa.ListArray.from_arrays(_offsets(sizes), pa.concat_arrays(parts) if parts else pa.array([], type=kind))

    return _called_once(counts, COUNTS if held is None else "array<struct<t:int,c:bigint>>")(col)


def listed_values(items: Column, held, sublinear: bool, norm: str | None) -> Column:
    """``(term, value)`` lists of lists of ``(term, c)``; ``held`` broadcasts the vocabulary and its terms' factors."""
    def values(col: pa.Array) -> pa.Array:
        terms, factor = held.value
        flat, row = col.flatten(), np.repeat(np.arange(len(col)), _sizes(col))
        at = pc.index_in(flat.field(0), value_set=terms)
        known = pc.is_valid(at)
        row, term, c = row[known.to_numpy(zero_copy_only=False)], flat.field(0).filter(known), flat.field(1).filter(known)
        c = c.to_numpy(zero_copy_only=False).astype(np.float64)
        v = (1.0 + np.log(c) if sublinear else c) * factor[at.filter(known).to_numpy(zero_copy_only=False)]
        if norm:
            total = np.bincount(row, np.abs(v), len(col)) if norm == "l1" else np.sqrt(np.bincount(row, v * v, len(col)))
            v = np.divide(v, total[row], out=np.zeros(len(v)), where=total[row] > 0)
        return pa.ListArray.from_arrays(_offsets(np.bincount(row, minlength=len(col))),
                                        pa.StructArray.from_arrays([term, pa.array(v)], names=["term", "value"]))

    return _called_once(values, "array<struct<term:string,value:double>>")(items)
