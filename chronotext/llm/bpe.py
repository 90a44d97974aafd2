"""BPE encoding and decoding by batched numpy merge rounds.

A batch of texts is cut at white space (no token of this vocabulary crosses
it), and the distinct pieces are encoded together: the symbols of all their
words lie in one flat array, each round looks every neighbouring pair up by
binary search over the sorted pair keys, and merges the lowest-rank pair of
each word wherever it occurs. A merged token comes from one merge only, so a
pair made in a round always ranks after the pair that made it, and merging all
occurrences of a word's lowest pair at once equals merging one at a time.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package, text_slices, tidied, to_batches, worker_model

# Fixed values of the public vocabulary's format: its white space and its word pattern.
SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+"

_BIG = np.int64(1) << 40


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(extra)
            extra += 1
    return [names[b] for b in range(256)]


class WordBpe:
    """Encoder and decoder of a byte-level word BPE file (``word_bpe_49k.json``)."""

    def __init__(self, path: str, cache_chars: int = 6_000_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *special.values()]) + 1
        self.tokens = [""] * size
        for t, i in [*vocab.items(), *special.items()]:
            self.tokens[i] = t
        self.size = np.int64(size)
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        order = np.argsort(left * size + right, kind="stable")
        self.pair_keys = (left * size + right)[order]
        self.pair_ranks = order.astype(np.int64)
        self.pair_ids = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)[order]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        self.words = regex.compile(WORDS)
        self.special = special
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.cache_chars = cache_chars
        self._reset()

    def _reset(self):
        self.known: dict[str, int] = {}
        self.known_chars = 0
        self.starts = np.zeros(0, dtype=np.int64)
        self.lens = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.uint32)

    @staticmethod
    def normalise(text: str) -> str:
        """NFC, then lower case of each character by itself (no final sigma)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """Normalised runs between white space; a special token is kept behind a line feed."""
        if self.special_re is not None and any(s in text for s in self.special):
            out, at = [], 0
            for m in self.special_re.finditer(text):
                out += self._runs(text[at:m.start()])
                out.append("\n" + m.group())
                at = m.end()
            return out + self._runs(text[at:])
        return self._runs(text)

    def _runs(self, text: str) -> list[str]:
        text = self.normalise(text)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):  # space for str.split, not for the vocabulary
            return [r for r in regex.split(f"[{SPACE}]+", text) if r]
        return text.split()

    def _learn(self, new: list[str]) -> None:
        """Encode distinct pieces and add them to the cache."""
        word_of: dict[str, int] = {}
        parts, counts = [], []
        for piece in new:
            if piece.isalpha():  # one word, the usual case
                parts.append(word_of.setdefault(piece, len(word_of)))
                counts.append(1)
                continue
            words = [] if piece[0] == "\n" else self.words.findall(piece)
            parts += [word_of.setdefault(w, len(word_of)) for w in words]
            counts.append(len(words))
        ids, lens = self._merge([w.encode("utf-8") for w in word_of])
        starts = np.concatenate([[0], np.cumsum(lens)[:-1]]) if len(lens) else lens
        parts = np.array(parts, dtype=np.int64)
        flat = ids[_ranges(starts[parts], lens[parts])] if len(parts) else np.zeros(0, dtype=np.uint32)
        per_word = np.concatenate([[0], np.cumsum(lens[parts])]) if len(parts) else np.zeros(1, dtype=np.int64)
        ends = per_word[np.cumsum(counts)]
        at = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        length = (ends - at).astype(np.int64)
        extra = []
        for k, piece in enumerate(new):
            if piece[0] == "\n":
                at[k], length[k] = len(flat) + len(extra), 1
                extra.append(self.special[piece[1:]])
        base = len(self.flat)
        self.flat = np.concatenate([self.flat, flat, np.array(extra, dtype=np.uint32)])
        first = len(self.starts)
        self.starts = np.concatenate([self.starts, at + base])
        self.lens = np.concatenate([self.lens, length])
        self.known.update(zip(new, range(first, first + len(new)), strict=True))
        self.known_chars += sum(map(len, new))

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over all words at once; flat ids and the number of ids of each word."""
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        sym = self.inner[raw]
        ends = np.cumsum(lens) - 1
        sym[ends] = self.final[raw[ends]]
        word = np.repeat(np.arange(len(words)), lens)
        done_sym, done_word = [], []
        rank, made = np.full(len(sym), _BIG), np.zeros(len(sym), dtype=np.int64)
        changed = np.arange(len(sym))
        while len(sym):
            self._look_up(sym, word, rank, made, changed)
            first = np.empty(len(sym), dtype=bool)
            first[0] = True
            np.not_equal(word[1:], word[:-1], out=first[1:])
            starts = np.flatnonzero(first)
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            over = lowest == _BIG
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
            take = (rank == lowest) & ~over
            chosen = np.flatnonzero(take)
            if (take[1:] & take[:-1]).any():  # x x x: every second pair of a run, from its left
                fresh = np.concatenate([[True], np.diff(chosen) > 1])
                chosen = chosen[(chosen - chosen[fresh][np.cumsum(fresh) - 1]) % 2 == 0]
            sym[chosen] = made[chosen]
            keep = ~over
            keep[chosen + 1] = False
            place = (np.cumsum(keep) - 1)[chosen]
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            before = place[place > 0] - 1
            changed = np.concatenate([place, before[word[before] == word[before + 1]]])
        if not done_sym:
            return np.zeros(0, dtype=np.uint32), lens
        word = np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.concatenate(done_sym)[order].astype(np.uint32), np.bincount(word, minlength=len(words))

    def _look_up(self, sym, word, rank, made, at) -> None:
        """Rank and merged id of the pairs that begin at ``at``, by binary search."""
        rank[at] = _BIG
        at = at[at < len(sym) - 1]
        at = at[word[at] == word[at + 1]]
        key = sym[at] * self.size + sym[at + 1]
        found = np.searchsorted(self.pair_keys, key)
        found[found == len(self.pair_keys)] = 0
        hit = self.pair_keys[found] == key
        at, found = at[hit], found[hit]
        rank[at], made[at] = self.pair_ranks[found], self.pair_ids[found]

    def encode_batch(self, texts: list[str | None]) -> list[np.ndarray]:
        """Token ids (uint32) of each whole text; null counts as empty."""
        if self.known_chars > self.cache_chars:
            self._reset()
        per_text = [self.pieces(t) if t else [] for t in texts]
        everything = [p for ps in per_text for p in ps]
        new = list(set(everything) - self.known.keys())
        if new:
            self._learn(new)
        at = np.fromiter(map(self.known.__getitem__, everything), dtype=np.int64, count=len(everything))
        lens = self.lens[at]
        ids = self.flat[_ranges(self.starts[at], lens)]
        upto = np.concatenate([[0], np.cumsum(lens)])
        cuts = upto[np.cumsum([len(ps) for ps in per_text])[:-1]] if per_text else []
        return np.split(ids, np.asarray(cuts, dtype=np.int64))

    def decode(self, ids) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.asarray(ids).tolist()))


def _ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All positions start, start+1, ... of ranges, in order."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total)


def load_bpe(path: str) -> WordBpe:
    return worker_model(("bpe", path), lambda: WordBpe(path))


def encode_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     path: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256[, ids])`` for every row.

    Null and empty texts have no tokens; repeated rows and null ids each keep
    their row; other columns of ``df`` are not read; an empty table gives an
    empty table. Map-only: no shuffle, and a lost task is simply run again.
    """
    spark: SparkSession = df.sparkSession
    ship_package(spark)
    path = path or default_path()
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                        ("decoded_sha256", pa.string())] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))

    def run(batches):
        bpe = load_bpe(path)

        def rows():
            for b in batches:
                keys = b.column("doc_id").to_pylist()
                for lo, hi, texts in text_slices(b, "text"):
                    for key, ids in zip(keys[lo:hi], bpe.encode_batch(texts), strict=True):
                        yield (key, len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                               hashlib.sha256(bpe.decode(ids).encode("utf-8")).hexdigest(),
                               *((ids.tolist(),) if with_ids else ()))
        with tidied():
            yield from to_batches(rows(), schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>" if with_ids else "")
    return src.mapInArrow(run, ddl)
