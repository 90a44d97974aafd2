"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A text is read as overlapping windows of words. A word enters as the embedding
of its own (if the training sample has it often enough) beside the mean
embedding of its character trigrams. Two gated recurrent layers read a window
in both directions, attention pools their states, and a text scores as its
highest window. Only texts are labelled, so a toxic text's windows share its
label softly in training, while every window of a clean text is clean.
"""

from __future__ import annotations

import hashlib
import io
import re
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, ship_package, text_slices, tidied, to_batches, worker_model

THRESHOLD = 0.3
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


@dataclass(frozen=True)
class Params:
    """The sample bounds are the only caps, and they bound the training sample alone."""

    max_toxic: int = 1000  # sampled training texts of label 1
    max_clean: int = 1500  # and of label 0
    max_chars: int = 4000  # longest of them
    calibrate_toxic: int = 300  # further texts, of any length up to the next bound, that fix the scale of scores
    calibrate_clean: int = 900
    calibrate_chars: int = 30_000
    min_word_texts: int = 5  # a word gets its own embedding from so many sampled texts on
    window: int = 32  # words in a window
    stride: int = 24  # words from one window's start to the next
    word_dim: int = 8
    char_dim: int = 8
    char_rows: int = 4096
    hidden: int = 8
    updates: int = 500
    batch_texts: int = 24
    rate: float = 0.01
    seed: int = 7


def trigram_rows(words: list[str], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of ``^word$`` (flat row numbers) and their number for each word."""
    flat = np.frombuffer("".join([f"^{w}$" for w in words]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    h = np.zeros(len(flat), dtype=np.uint64)
    h[:-2] = flat[:-2] * np.uint64(0x9E3779B97F4A7C15) + flat[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + flat[2:] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    ends = np.cumsum(lens)
    keep = np.ones(len(flat), dtype=bool)
    keep[ends - 1] = keep[ends - 2] = False
    return (h[keep] % np.uint64(rows)).astype(np.int64), lens - 2


def plain(chunk: str) -> str:
    """A word without the punctuation around it; a chunk of punctuation stays as it is."""
    return chunk if chunk.isalpha() else _EDGE.sub("", chunk) or chunk


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _tanh(x):
    return 2 / (1 + np.exp(-2 * x)) - 1


def _sums(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of ``values`` by row number, for ``n`` rows."""
    out = np.zeros((n, values.shape[1]), dtype=np.float32)
    if len(rows):
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        out[rows[first]] = np.add.reduceat(values[order], first, axis=0)
    return out


class Network:
    """Parameters by name, forward scores, and gradients by back-propagation through time."""

    def __init__(self, p: Params, vocabulary: list[str]):
        self.p, self.vocabulary = p, {w: i + 1 for i, w in enumerate(vocabulary)}
        g = np.random.default_rng(p.seed)
        d, h = p.word_dim + p.char_dim, p.hidden
        n = lambda *s: (g.standard_normal(s) * 0.1).astype(np.float32)
        self.w = {"word": n(len(vocabulary) + 1, p.word_dim), "char": n(p.char_rows, p.char_dim) * 3,
                  "scale": np.array([1, 0], dtype=np.float32), "pool_w": n(h), "pool_v": n(2 * h, h), "out": n(2 * h), "bias": np.array([-2.0], dtype=np.float32)}
        for s in "fb":
            self.w |= {f"in_{s}": n(d, 3 * h) * 3, f"rec_{s}": n(h, 3 * h) * 3, f"b_{s}": np.zeros(3 * h, dtype=np.float32)}

    # --- inputs -------------------------------------------------------------------------

    def words_in(self, words: list[str]) -> tuple:
        """Rows of the word and character tables for distinct words."""
        own = np.array([self.vocabulary.get(w, 0) for w in words], dtype=np.int64)
        rows, lens = trigram_rows(words, self.p.char_rows)
        return own, rows, lens

    def embed(self, own, rows, lens) -> np.ndarray:
        if not len(own):
            return np.zeros((0, self.p.word_dim + self.p.char_dim), dtype=np.float32)
        starts = np.cumsum(lens) - lens
        chars = np.add.reduceat(self.w["char"][rows], starts, axis=0) / lens[:, None].astype(np.float32)
        return np.concatenate([self.w["word"][own], chars], axis=1, dtype=np.float32)

    def windows(self, n_words: int) -> np.ndarray:
        """Starts of the overlapping windows of a text; the last one ends with the text."""
        p = self.p
        if n_words <= p.window:
            return np.zeros(1, dtype=np.int64)
        return np.unique(np.append(np.arange(0, n_words - p.window, p.stride), n_words - p.window))

    # --- the network --------------------------------------------------------------------

    def _gru(self, proj, at, mask, s, keep):
        """States (time, windows, hidden) of one direction; ``proj``: projected inputs, ``at``: their rows."""
        h_n = self.p.hidden
        rec = self.w[f"rec_{s}"]
        steps, n = at.shape
        state = np.zeros((n, h_n), dtype=np.float32)
        states, kept = np.empty((steps, n, h_n), dtype=np.float32), []
        for t in (range(steps) if s == "f" else range(steps - 1, -1, -1)):
            x, r = proj[at[t]], state @ rec
            gates = _sigmoid(x[:, :2 * h_n] + r[:, :2 * h_n])
            z, reset = gates[:, :h_n], gates[:, h_n:]
            new = _tanh(x[:, 2 * h_n:] + reset * r[:, 2 * h_n:])
            step = (z * mask[t][:, None])
            if keep:
                kept.append((t, state, r[:, 2 * h_n:], z, reset, new))
            state = state + step * (new - state)
            states[t] = state
        return states, kept

    def logits(self, inputs, at, mask, keep=False, projected=None):
        """Logit of each window. ``at``: (time, windows) rows of ``inputs``; ``mask``: 1 where there is a word."""
        w = self.w
        hs, kept = {}, {}
        for s in "fb":
            proj = (inputs @ w[f"in_{s}"] + w[f"b_{s}"]) if projected is None else projected[s]
            hs[s], kept[s] = self._gru(proj, at, mask, s, keep)
        h = np.concatenate([hs["f"], hs["b"]], axis=2)
        u = _tanh(h @ w["pool_v"])
        e = u @ w["pool_w"]
        e = np.where(mask > 0, e, np.float32(-1e9))
        a = np.exp(e - e.max(axis=0))
        a = a * mask
        a /= np.maximum(a.sum(axis=0), np.float32(1e-9))
        pooled = (a[:, :, None] * h).sum(axis=0)
        out = pooled @ w["out"] + w["bias"][0]
        return (out, (h, u, a, pooled, kept)) if keep else out

    def gradients(self, inputs, at, mask, tables, d_out, tape) -> dict[str, np.ndarray]:
        w, h_n = self.w, self.p.hidden
        h, u, a, pooled, kept = tape
        g = {"out": pooled.T @ d_out, "bias": np.array([d_out.sum()], dtype=np.float32)}
        d_pooled = d_out[:, None] * w["out"]
        d_h = a[:, :, None] * d_pooled
        d_a = np.einsum("nh,tnh->tn", d_pooled, h)
        d_e = a * (d_a - (a * d_a).sum(axis=0))
        g["pool_w"] = np.einsum("tn,tnh->h", d_e, u)
        d_u = d_e[:, :, None] * w["pool_w"] * (1 - u * u)
        g["pool_v"] = np.einsum("tnh,tnk->hk", h, d_u)
        d_h = d_h + d_u @ w["pool_v"].T
        d_in = np.zeros_like(inputs)
        for k, s in enumerate("fb"):
            d_xs = np.empty((*at.shape, 3 * h_n), dtype=np.float32)
            d_rec = np.zeros_like(w[f"rec_{s}"])
            d_state = np.zeros((at.shape[1], h_n), dtype=np.float32)
            for t, before, r_new, z, reset, new in reversed(kept[s]):
                d_state = d_state + d_h[t, :, k * h_n:(k + 1) * h_n]
                m = mask[t][:, None]
                d_new = d_state * z * m * (1 - new * new)
                d_z = d_state * (new - before) * m * z * (1 - z)
                d_reset = d_new * r_new * reset * (1 - reset)
                d_r = np.concatenate([d_z, d_reset, d_new * reset], axis=1)
                d_xs[t] = np.concatenate([d_z, d_reset, d_new], axis=1)
                d_rec += before.T @ d_r
                d_state = d_state * (1 - z * m) + d_r @ w[f"rec_{s}"].T
            d_proj = _sums(at.ravel(), d_xs.reshape(-1, 3 * h_n), len(inputs))
            g[f"rec_{s}"], g[f"b_{s}"], g[f"in_{s}"] = d_rec, d_proj.sum(axis=0), inputs.T @ d_proj
            d_in += d_proj @ w[f"in_{s}"].T
        own, rows, lens = tables
        g["word"] = _sums(own, d_in[:, :self.p.word_dim], len(w["word"]))
        g["char"] = _sums(rows, np.repeat(d_in[:, self.p.word_dim:] / lens[:, None], lens, axis=0), len(w["char"]))
        return g

    # --- training -----------------------------------------------------------------------

    def layout(self, texts: list[list[str]]) -> tuple:
        """Distinct words, window positions (time, windows), mask, and the text of each window."""
        known: dict[str, int] = {}
        at, mask, owner = [], [], []
        for k, words in enumerate(texts):
            ids = np.array([known.setdefault(x, len(known)) for x in words], dtype=np.int64)
            for start in self.windows(len(ids)):
                part = ids[start:start + self.p.window]
                at.append(np.pad(part, (0, self.p.window - len(part))))
                mask.append(np.arange(self.p.window) < len(part))
                owner.append(k)
        return (list(known) or ["^"], np.array(at).T.copy(), np.array(mask).T.astype(np.float32), np.array(owner))

    def fit(self, texts: list[list[str]], labels: np.ndarray) -> Network:
        p, g = self.p, np.random.default_rng(self.p.seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v = {k: np.zeros_like(x) for k, x in self.w.items()}
        order, step = np.zeros(0, dtype=np.int64), 0
        while step < p.updates:
            if not len(order):
                order = g.permutation(len(texts))
            chosen, order = order[:p.batch_texts], order[p.batch_texts:]
            words, at, mask, owner = self.layout([texts[i] for i in chosen])
            tables = self.words_in(words)
            inputs = self.embed(*tables)
            out, tape = self.logits(inputs, at, mask, keep=True)
            d = np.zeros_like(out)
            for k, i in enumerate(chosen):
                mine = np.flatnonzero(owner == k)
                if labels[i]:  # the text is toxic if some window is
                    top = out[mine].max()
                    soft = np.exp(out[mine] - top)
                    d[mine] = (_sigmoid(top + np.log(soft.sum())) - 1) * soft / soft.sum()
                else:  # no window is
                    d[mine] = _sigmoid(out[mine])
            grads = self.gradients(inputs, at, mask, tables, (d / len(chosen)).astype(np.float32), tape)
            size = np.sqrt(sum(float((x * x).sum()) for x in grads.values()))
            step += 1
            rate = p.rate * (1.1 - step / p.updates)
            for name, x in grads.items():
                x = x * min(1.0, 5.0 / (size + 1e-9))
                m[name] += 0.1 * (x - m[name])
                v[name] += 0.01 * (x * x - v[name])
                self.w[name] -= (rate * (m[name] / (1 - 0.9 ** step))
                                 / (np.sqrt(v[name] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
        return self

    def calibrate(self, logits: np.ndarray, labels: np.ndarray) -> Network:
        """Logistic fit of labels on the highest windows' logits of texts that the network was not fitted on."""
        if len(set(labels.tolist())) == 2:
            x = np.stack([np.clip(logits, -20, 20), np.ones_like(logits)], axis=1)
            w = np.array([1.0, 0.0])
            for _ in range(3000):
                w -= 0.02 * (x.T @ (_sigmoid(x @ w) - labels) / len(x) + 0.01 * (w - [1.0, 0.0]))
            if np.isfinite(w).all() and w[0] > 0:
                self.w["scale"] = w.astype(np.float32)
        return self

    # --- shipping -----------------------------------------------------------------------

    def dump(self) -> bytes:
        buf = io.BytesIO()
        np.savez(buf, vocabulary=np.array(list(self.vocabulary), dtype="U"),
                 params=np.array([float(getattr(self.p, f.name)) for f in fields(Params)]),
                 **{f"w_{k}": x for k, x in self.w.items()})
        return buf.getvalue()


def load_scorer(model: bytes) -> Scorer:
    return worker_model(("toxicity", hashlib.sha256(model).digest()), lambda: Scorer(model))


class Scorer:
    """Scores whole texts; a distinct word's projected input is made once and kept."""

    def __init__(self, model: bytes, cache_words: int = 100_000):
        z = np.load(io.BytesIO(model))
        p = Params(**{f.name: type(f.default)(x) for f, x in zip(fields(Params), z["params"], strict=True)})
        self.net = Network(p, [])
        self.net.vocabulary = {w: i + 1 for i, w in enumerate(z["vocabulary"].tolist())}
        self.net.w = {k[2:]: z[k] for k in z.files if k.startswith("w_")}
        self.cache_words = cache_words
        self._reset()

    def _reset(self):
        h3 = 3 * self.net.p.hidden
        self.known: dict[str, int] = {}
        self.proj = {s: np.zeros((1, h3), dtype=np.float32) for s in "fb"}  # row 0: no word

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of each text, from its highest window. A text without words is one empty window."""
        a, b = self.net.w["scale"].astype(float)
        return _sigmoid(np.clip(a * self.logits(texts) + b, -30, 30))

    def logits(self, texts: list[str | None]) -> np.ndarray:
        net, p = self.net, self.net.p
        if len(self.known) > self.cache_words:
            self._reset()
        per_text = [(t or "").lower().split() for t in texts]
        everything = [c for cs in per_text for c in cs]
        new = list(set(everything) - self.known.keys())
        if new:
            x = net.embed(*net.words_in([plain(c) for c in new]))
            first = len(self.proj["f"])
            for s in "fb":
                self.proj[s] = np.concatenate([self.proj[s], x @ net.w[f"in_{s}"] + net.w[f"b_{s}"]])
            self.known.update(zip(new, range(first, first + len(new)), strict=True))
        flat = np.fromiter(map(self.known.__getitem__, everything), dtype=np.int64, count=len(everything))
        flat = np.append(flat, np.zeros(p.window, dtype=np.int64))
        starts, left, owner, at = [], [], [], 0
        for k, cs in enumerate(per_text):
            w = net.windows(len(cs))
            starts.append(at + w)
            left.append(np.minimum(p.window, len(cs) - w))
            owner.append(np.full(len(w), k))
            at += len(cs)
        starts, left, owner = (np.concatenate(x) for x in (starts, left, owner))
        best = np.full(len(texts), -np.inf)
        steps = np.arange(p.window)[:, None]
        for lo in range(0, len(starts), 2048):
            part = slice(lo, lo + 2048)
            mask = (steps < left[part]).astype(np.float32)
            rows = np.where(mask > 0, flat[starts[part] + steps], 0)
            np.maximum.at(best, owner[part], net.logits(None, rows, mask, projected=self.proj))
        return best


def training_part(id_col: Column) -> Column:
    """Rows that labels may be learned from: crc32 of the id as text, modulo 4, is not 2."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 != 2


def train(docs: DataFrame, labels: DataFrame, params: Params = Params(), id_col: str = "doc_id",
          text_col: str = "text", label_col: str = "toxic") -> bytes:
    """Fit on a bounded sample of labelled texts of the training part; the model's bytes.

    Without any labelled training text the network stays as initialised, with
    all scores low.
    """
    p = params
    part = F.crc32(F.coalesce(F.col("k").cast("string"), F.lit("")).cast("binary")) % 4
    rows = (docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t"))
            .where(training_part(F.col("k")) & F.col("t").isNotNull())
            .join(labels.select(F.col(id_col).alias("k"), F.col(label_col).alias("y")).where("y in (0, 1)"), "k"))

    def sample(which: Column, chars: int, most: dict[int, int]) -> list:
        chosen = rows.where(which & (F.length("t") <= chars))
        draw = F.xxhash64(F.col("k"), F.lit(p.seed))
        return [r for y, n in most.items()
                for r in bounded_sample(chosen.where(F.col("y") == y), draw, n, "t").select("t", "y").collect()]

    fitted = sample(part != 3, p.max_chars, {1: p.max_toxic, 0: p.max_clean})
    texts = [[plain(c) for c in r.t.lower().split()] for r in fitted]
    seen: dict[str, int] = {}
    for ws in texts:
        for x in set(ws):
            seen[x] = seen.get(x, 0) + 1
    net = Network(p, sorted(x for x, n in seen.items() if n >= p.min_word_texts))
    if texts:
        net.fit(texts, np.array([r.y for r in fitted]))
        checked = sample(part == 3, p.calibrate_chars, {1: p.calibrate_toxic, 0: p.calibrate_clean})
        if checked:
            net.calibrate(Scorer(net.dump()).logits([r.t for r in checked]), np.array([r.y for r in checked]))
    return net.dump()


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row.

    Null and empty texts score as one empty window; repeated rows and null ids
    keep their rows (a null id counts as an empty text for ``held_out``);
    other columns are not read; an empty table gives an empty table. Map-only.
    """
    ship_package(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), (~training_part(F.col(id_col))).alias("held_out"),
                      F.col(text_col).alias("text"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # bounded by Params: the sample's words and the tables
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()),
                        ("predicted", pa.int32())])

    def run(batches):
        scorer = load_scorer(held.value)

        def rows():
            for b in batches:
                for lo, hi, texts in text_slices(b, "text", 1_000_000):
                    got = scorer.scores(texts).tolist()
                    yield from zip(b.column("doc_id").to_pylist()[lo:hi], b.column("held_out").to_pylist()[lo:hi],
                                   got, [int(s >= threshold) for s in got], strict=True)
        with tidied():
            yield from to_batches(rows(), schema)

    return src.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: bytes, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose text scores below ``threshold``, with all their columns.

    Null and empty texts score as one empty window; rows that repeat score
    alike; null ids and other columns, whatever their names, stay as they are;
    an empty table gives an empty table. Map-only.
    """
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = load_scorer(held.value)
        with tidied():
            for b in batches:
                keep = [s < threshold for _, _, texts in text_slices(b, text_col, 1_000_000) for s in scorer.scores(texts).tolist()]
                yield b.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

