"""Edge cases of the training-data operators: hot nodes, many lengths, hash collisions, odd JSON, long texts."""

import json
import random
import string
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronotext.llm import bucket_join, chat, embedding_dedup, license_scan, ngram_join, secret_scan, suffix_dedup


def text_of(rng, n, words=4000):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# --- n-gram join -------------------------------------------------------------------------

def test_mean_similarity_of_a_node_by_random_signs(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for node, common in enumerate((0, 16, 48, 64)):  # values that all members share
        shared = rng.integers(0, 1 << 62, 64)
        sigs = []
        for k in range(300):
            sig = rng.integers(0, 1 << 62, 64)
            own = np.arange(64) % 64 < common
            sig[own] = shared[own]
            sigs.append(sig)
            rows.append((node, 1000 * node + k, bytes(sig.astype("<u8").tobytes())))
        counts = Counter(v for s in sigs for v in s[::8].tolist())
        want[node] = sum(c * c for c in counts.values()) / (8 * len(sigs))
    df = spark.createDataFrame(rows, "node long, item long, payload binary")
    counted = df.groupBy("node").agg(*ngram_join._sign_sums())
    got = {r.node: r.peers for r in counted.select("node", ngram_join._peers().alias("peers")).collect()}
    for node, peers in want.items():
        assert abs(got[node] - peers) <= 0.8 * peers, (node, got[node], peers)
    assert got[3] > 0.5 * 300 > got[0]


def test_blocks_are_cut_by_bytes(spark, monkeypatch):
    rng = random.Random(3)
    base = text_of(rng, 400).split()
    texts = []
    for k in range(40):
        copy = list(base)
        copy[rng.randrange(400)] = f"x{k}"
        texts.append(" ".join(copy))
    sets = ngram_join.Shingler().sets(texts)
    items = spark.createDataFrame([(k, 1, bytes(s.astype("<u8").tobytes())) for k, s in enumerate(sets)], "item long, n long, payload binary")
    members = spark.createDataFrame([(7, k, 40) for k in range(40)], "node long, item long, size long")
    whole = len(bucket_join._comparisons(members, items.withColumn("nodes", F.array().cast("array<long>")), 512).select("i", "j").distinct().collect())
    monkeypatch.setattr(bucket_join, "BLOCK_BYTES", 20_000)
    cut = bucket_join._comparisons(members, items.withColumn("nodes", F.array().cast("array<long>")), 512).select("i", "j").distinct().count()
    assert whole == 1 and cut > 6
    counts, edges = bucket_join.links(members, items, ngram_join._jaccard(0.8))
    assert {r.item: r.links for r in counts.collect()} == dict.fromkeys(range(40), 39)
    assert {r.component for r in bucket_join.components(edges).collect()} == {0}


# --- embeddings --------------------------------------------------------------------------

def test_vectors_of_many_lengths(spark):
    rng = np.random.default_rng(2)
    rows = []
    for dim in range(1, 76):
        v = rng.standard_normal(dim)
        rows += [(len(rows), 1, v.tolist()), (len(rows) + 1, 1, (v * 3).tolist()), (len(rows) + 2, 2, v.tolist())]
    first = len(rows)
    for k in range(700):  # one length that is coded
        if k % 7 == 0:
            base = rng.standard_normal(16)
        rows.append((first + k, 3, (base + 0.1 * rng.standard_normal(16)).tolist()))
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    for k in range(0, first, 3):
        assert (got[k].n_links, got[k + 1].component_id, got[k + 2].n_links) == (1, k, 0)
    x = np.array([r[2] for r in rows[first:]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = ((x @ x.T) >= 0.93).sum(axis=1) - 1
    assert sum(got[first + k].n_links for k in range(700)) >= 0.97 * want.sum()


# --- repeated strings --------------------------------------------------------------------

def test_equal_hashes_are_not_equal_stretches(monkeypatch):
    # with the base 1 the polynomial hash is the sum of the bytes, so that collisions are easily made
    monkeypatch.setattr(suffix_dedup, "_BASE", np.uint64(1))
    monkeypatch.setattr(suffix_dedup, "_INVERSE", np.uint64(1))
    monkeypatch.setattr(suffix_dedup, "_powers", [np.ones(1, dtype=np.uint64)] * 2)
    rng = random.Random(1)
    a = "".join(rng.choice(string.ascii_lowercase) for _ in range(360)).encode()
    b = a[:5] + a[6:7] + a[5:6] + a[7:]
    whole = [suffix_dedup.PrefixHashes(np.frombuffer(t, dtype=np.uint8)).piece(0, 360) for t in (a, b)]
    assert whole[0] == whole[1] and suffix_dedup.digest(a, 0, 161, 20) != suffix_dedup.digest(b, 0, 161, 20)
    assert suffix_dedup.digest(a, 0, 161, 20) != suffix_dedup.digest(a, 0, 161, 21)
    strings = np.array([161, 161])
    flags = suffix_dedup.repeated_strings([a, b], strings, np.zeros(2, dtype=np.int64))
    same = [a[k:k + 200] == b[k:k + 200] for k in range(161)]
    assert flags[:161].tolist() == flags[161:].tolist() == same and not all(same)


def test_long_texts_are_dealt_in_parts():
    rng = random.Random(6)
    body = "".join(rng.choice("abcd") for _ in range(3000)).encode()
    _, start, strings, lead, anchor = suffix_dedup.stretches([body])
    want = {s + k: (a, s + g) for s, n, g, a in zip(start.tolist(), strings.tolist(), lead.tolist(), anchor.tolist(), strict=True) for k in range(n)}
    got = {}
    for start, strings, lead, anchor in suffix_dedup.dealt_stretches(body, most=500):
        for s, n, g, a in zip(start.tolist(), strings.tolist(), lead.tolist(), anchor.tolist(), strict=True):
            for k in range(n):
                assert s + k not in got
                got[s + k] = (a, s + g)
    assert got == want and len(got) == 3000 - 199


# --- chats -------------------------------------------------------------------------------

def test_lone_surrogates_and_deep_nesting(spark):
    call = lambda t, i, args: (1, t, "assistant", None, i, "f", args)
    rows = [call(1, "a", '{"query":"\\ud800"}'), call(2, "b", '{"x\\udfff":{"$result":"\\ud800"}}'), call(3, "c", '{"pair":"\\ud83d\\ude00"}'),
            call(4, "d", '{"a":' * 100_000 + "1" + "}" * 100_000), call(5, "e", "[" * 900 + "]" * 900), call(6, "f", '{"big":1e999}')]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, name string, arguments string")
    got = {r.call_id: r for r in chat.format_chats(df, {"f": {"type": "object", "additionalProperties": False, "properties": {"query": {}, "pair": {}, "a": {}}}}).collect()}
    assert got["a"].status == "unanswered" and '"query":"\\ud800"' in got["a"].message
    assert json.loads(got["a"].message)["tool_call"]["arguments"] == {"query": "\ud800"}
    assert got["b"].status == "invalid" and got["b"].errors == ".x\\udfff:unknown"
    assert got["c"].status == "unanswered" and "\U0001f600" in got["c"].message
    assert got["d"].status == "bad_json" and got["f"].status == "bad_json" and got["e"].status in ("invalid", "bad_json")


# --- secrets -----------------------------------------------------------------------------

@pytest.mark.parametrize("letters", [string.ascii_lowercase, string.ascii_letters, string.digits, string.ascii_uppercase, string.digits + string.ascii_lowercase])
def test_strings_of_any_kind_of_characters_are_measured(letters):
    rng, scanner = random.Random(9), secret_scan.Scanner()
    found = 0
    for _ in range(40):
        text = f"The header was Authorization: Bearer {''.join(rng.choices(letters, k=32))} and it was sent again by the client."
        found += (37, 69) in [s[:2] for s in scanner.scan(text)[1]]  # digits alone are a base span
    assert found >= 34


def test_web_tokens_are_one_span():
    rng = random.Random(4)
    token = ".".join("".join(rng.choices(string.ascii_letters + string.digits + "-_", k=k)) for k in (36, 74, 43))
    text = f"Authorization: Bearer {token}. Then it was sent."
    assert [text[s:e] for s, e, k in secret_scan.Scanner().scan(text)[1]] == [token]


def test_names_made_of_words_are_left_alone():
    names = ("authenticationmanager", "getUserAuthenticationToken", "connection_parameters", "defaultCredentialProvider",
             "configurationfilename", "internal_server_error", "requestHeaderName", "publicKeyIdentifier")
    scanner = secret_scan.Scanner()
    assert sum(bool(scanner.scan(f"the token {n} is read from the file and passed on to the server.")[1]) for n in names) <= 1


def test_many_sensitive_words_take_linear_time():
    scanner = secret_scan.Scanner()
    for piece in ("token ", "secret_", "token abc", "bearer\n"):
        began = time.perf_counter()
        scanner.scan(piece * 100_000)
        assert time.perf_counter() - began < 5, piece


# --- licenses ----------------------------------------------------------------------------

def test_titles_identifiers_and_texts_of_common_licenses():
    matcher = license_scan.LicenseMatcher()
    for text, name in (("The MIT License (MIT)", "MIT"), ("MIT License\n\nCopyright (c) 2021 A. Person", "MIT"),
                       ("                                 Apache License\n                           Version 2.0, January 2004", "Apache-2.0"),
                       ("GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999", "LGPL-2.1"),
                       ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"), ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
                       ("Distributed under the Boost Software License, Version 1.0. (See accompanying file)", "BSL-1.0"),
                       ("GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November 2007", "AGPL-3.0")):
        assert {f[0] for f in matcher.scan(f"/* file of a project\n * {text}\n */\nint main() {{ return 0; }}")} == {name}, text


def test_compression_proposes_what_wording_confirms():
    """Brute force: every template against every window of a text, by wording alone."""
    matcher, rng = license_scan.LicenseMatcher(), random.Random(5)
    notices = [(n, t) for n, ts in license_scan.TEMPLATES.items() for t in ts]
    for _ in range(40):
        parts, want = [], set()
        for _ in range(3):
            name, notice = rng.choice(notices)
            parts += [text_of(rng, rng.randrange(0, 60)), notice + ("" if notice.endswith((".", ":")) else ".")]
            want.add(name)
        text = "\n".join([*parts, text_of(rng, 30)])
        have = license_scan._WORD.findall(text.lower())
        plain = {n for n, t in notices for w in [license_scan._WORD.findall(t.lower())]
                 if any(have[i:i + len(w)] == w for i in range(len(have)))}
        assert want <= {f[0] for f in matcher.scan(text)} <= plain
