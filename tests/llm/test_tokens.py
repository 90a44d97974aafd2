"""BPE and packing against the tokenizers library."""

import hashlib
import random
import unicodedata
import zlib

import numpy as np
import pytest

from chronotext.llm import bpe, packing

ODD = ["", " ", "Hello  World's don't 123 <|endoftext|>x<|startoftext|> A", "a" * 3000, "!?--" * 500, "x\x1cy\x1f z",
       "".join(map(chr, [0x391, 0x3A3, 32, 0x130, 0xFB01, 0x65E5, 0x1F600, 0x200D, 0x85, 0xA0, 0x3000, 0xFEFF]))]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(bpe.default_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_encode_and_decode_equal_the_library(library):
    rng = random.Random(3)
    texts = list(ODD)
    while len(texts) < 300:
        chars = [chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0x600), rng.randrange(0x4E00, 0x9FA0), 32, 39]))
                 for _ in range(40)]
        texts.append("".join(c for c in chars if unicodedata.category(c) != "Cn"))
    ours = bpe.WordBpe(bpe.default_path())
    for text, got, want in zip(texts, ours.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert got.tolist() == want.ids, ascii(text)
        assert ours.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_cache_limit_changes_nothing():
    a, b = bpe.WordBpe(bpe.default_path()), bpe.WordBpe(bpe.default_path(), cache_chars=0)
    for text in ["the cat sat", "on the mat", "the cat again"]:
        assert a.encode_batch([text])[0].tolist() == b.encode_batch([text])[0].tolist()


def test_encode_documents_edge_rows(spark, library):
    rows = [(1, "One two", 9), (1, "One two", 9), (None, None, 9), (2, "", 9), (3, "word " * 50_000, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens): r for r in bpe.encode_documents(df).collect()}
    ids = library.encode("One two", add_special_tokens=False).ids
    one = got[(1, len(ids))]
    assert one.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert one.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert (None, 0) in got and (2, 0) in got and (3, 50_000) in got
    assert bpe.encode_documents(df.limit(0)).count() == 0


def first_fit(sizes, capacity):
    bins, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        for b, room in enumerate(bins):
            if room >= sizes[i]:
                break
        else:
            bins.append(capacity)
            b = len(bins) - 1
        bins[b] -= sizes[i]
        out[i] = b
    return out


def test_tournament_equals_plain_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 300):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        assert bins.tolist() == first_fit(sizes.tolist(), 100)
        for b in set(bins.tolist()):
            mine = sorted(zip(offsets[bins == b].tolist(), sizes[bins == b].tolist(), strict=True))
            assert [o for o, _ in mine] == np.cumsum([0] + [s for _, s in mine])[:-1].tolist()


def test_pieces_cover_documents_and_sequences_have_no_gaps(spark, library):
    rows = [(k, f"word{k} " * (k * 97 % 900), "x") for k in range(60)] + [(7, "again", "x"), (None, None, "x"), (99, "long " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = packing.pack_documents(df, group_pieces=16).collect()
    spans = {}
    for r in got:
        assert 0 < r.length <= 2048 and r.offset + r.length <= 2048
        spans.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
    ids = np.array(library.encode("long " * 9000, add_special_tokens=False).ids + [1], "<u4")
    mine = sorted((r.start, r.length, r.ids_crc32) for r in got if r.doc_id == 99)
    assert sum(n for _, n, _ in mine) == len(ids)
    assert all(zlib.crc32(ids[s:s + n].tobytes()) == c for s, n, c in mine)
    assert len({(r.doc_id, r.start, r.doc_tokens) for r in got}) == len(got)
    assert packing.pack_documents(df.limit(0)).count() == 0
