"""Secrets, licenses, toxicity and chats."""

import hashlib
import json
import random
import re
import zlib

import numpy as np

from chronotext.llm import chat, license_scan, secret_scan, toxicity


def base_by_plain_regex(text):
    found = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 12:
            found.append((m.start(), m.end(), 0))
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return sorted(found, key=lambda s: (s[0], s[2]))


def test_base_spans_against_plain_regex():
    rng, scanner = random.Random(1), secret_scan.Scanner()
    bits = ["secret=token: abcdefghijklm", "Password = 'abc", "api_key:", "APIKEY=\"", "AKIA", "AKIAABCDEFGHIJKLMN", "0123456789abcdef",
            "ſecret=abcdefghijklmnop", "toKen=abcdefghijklmnop", " ", "=", "x", "deadbeef", "ABCDEFGH1234"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 9)))
        assert scanner.base(text) == base_by_plain_regex(text), text


def test_novel_spans_and_masks(spark):
    key = "Zk93mXq0Lw7Pz1Rt5Yb8Nc2V"
    texts = [f"the Authorization header {key} is sent", f"plain {key} words", "secret placeholder your_api_key_here_000000000000000",
             "password=abcdefghijkl1 and deadbeefdeadbeef00", "", None, "clean words only " * 4000]
    rows = [(k, t, len(t or "")) for k, t in enumerate(texts)] + [(None, texts[3], 5), (3, texts[3], 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans int")
    got = secret_scan.find_secrets(df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and by[0].n_novel == 1 and by[0].spans == f"novel:25:{25 + len(key)}"
    assert by[1].spans == by[2].spans == by[4].spans == by[5].spans == by[6].spans == ""
    assert by[3].base_sha256 == hashlib.sha256(by[3].spans.encode()).hexdigest() and (by[3].n_assign, by[3].n_hex) == (1, 1)
    masked = {r.doc_id: r for r in secret_scan.mask_secrets(df, length_col="spans").collect()}
    assert masked[3].text == "<SECRET> and <SECRET>" and masked[3].spans == 21 and masked[5].text is None and masked[6].text == texts[6]
    assert secret_scan.masked("abcdef", [(1, 3, 0), (2, 4, 2), (5, 6, 1)]) == "a<SECRET>e<SECRET>"
    assert secret_scan.find_secrets(df.limit(0)).count() == 0


def test_novel_recall_by_alphabet_length_and_context():
    rng, scanner = random.Random(8), secret_scan.Scanner()
    digits, lower = "0123456789", "abcdefghijklmnopqrstuvwxyz"
    kinds = {"hex": digits + "ABCDEF", "lower": digits + lower, "upper": digits + lower.upper(), "mixed": digits + lower + lower.upper(),
             "base64": digits + lower + lower.upper() + "+/"}
    prose = "The service was started in the morning by the people who run it, and they said that all of the words were written by hand. "
    places = {"prose": (prose * 3 + "We keep the signature ", " in a safe place. " + prose), "code": ("def f(x):\n    auth = 'Bearer ", "'\n    return x\n"),
              "alone": ("Bearer ", "")}
    for place, (before, after) in places.items():
        for kind, letters in kinds.items():
            for n in (16, 20, 24, 32, 40, 64, 200):
                hits = tried = 0
                while tried < 40:
                    key = "".join(rng.choices(letters, k=n))
                    if any(c.isdigit() for c in key) and any(c.isalpha() for c in key) and not scanner.base(key):
                        tried += 1
                        hits += (len(before), len(before) + n, 3) in scanner.scan(before + key + after)[1]
                assert hits >= 34, (place, kind, n, hits)
        for name in ("your-access-token-goes-here-1", "getUserAccessTokenFromRequest2", "oauth2AuthorizationCodeFlow", "production_database_host1"):
            assert not scanner.scan(before + name + after)[1], (place, name)


def test_licenses(spark):
    texts = ["Words.\nReleased under the MIT License.\nMore.", "This work is licensed under the GNU General Public License, version 2.",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.",
             "Released under the influence.", "He lost his driving licence in public.", "", None,
             "x " * 5000 + "licensed. Licensed under the Apache License, Version 2.0. " + "y " * 5000,
             "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License."]
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)] + [(None, texts[0], 1), (0, texts[0], 1)], "doc_id long, text string, licenses int")
    got = license_scan.find_licenses(df).collect()
    by = {r.doc_id: r.licenses for r in got}
    assert [by[k] for k in range(11)] == ["MIT", "GPL-2.0", "GPL-3.0", "CC-BY-NC-4.0", "CC-BY-4.0", "", "", "", "", "Apache-2.0", "Apache-2.0,MIT"]
    assert len(got) == 13 and by[None] == "MIT"
    s = [r.spans for r in got if r.doc_id == 0][0].split(":")
    assert texts[0][int(s[1]):int(s[2])] == "Released under the MIT License."
    assert license_scan.find_licenses(df.limit(0)).count() == 0


def test_license_notices_inline_and_wrapped():
    matcher = license_scan.LicenseMatcher()
    notice = "Released under the MIT License."
    said = "Copyright (c) 2020 Jane Doe and contributors. "
    for text in (said + notice, "# Tool\n\nA small tool for parsing logs on many machines. " + notice + " See the docs for more.",
                 said * 3 + notice, said * 85 + notice, said * 100 + notice):  # on either side of 4,000 characters
        found = matcher.scan(text)
        assert [(f[0], text[f[1]:f[2]]) for f in found] == [("MIT", notice)], text[:80]
    names = lambda text: [f[0] for f in matcher.scan(text)]
    assert names(said + "Licensed under the Apache License, Version 2.0.") == ["Apache-2.0"]
    assert names("The texts were gathered by hand over many years. Licensed under CC BY 4.0.") == ["CC-BY-4.0"]
    assert names("Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0. Released under the MIT License.") == ["CC-BY-4.0", "CC-BY-NC-4.0", "MIT"]
    for name, texts in license_scan.TEMPLATES.items():
        for t in texts:
            words = t.split(" ")
            for width in (2, 3, 7):  # every template, wrapped after so many words, in a comment or not
                for mark in ("\n", "\n# ", "\n * "):
                    wrapped = mark.join(" ".join(words[k:k + width]) for k in range(0, len(words), width))
                    assert set(names(f"some words before\n{wrapped}\nand after")) == {name}, wrapped
    assert names("The licence was lost. The license of the house was released in the public domain of terms.") == []
    assert names("copyright " * 20_000) == []


def test_gradients_by_finite_differences():
    p = toxicity.Params(window=5, stride=3, hidden=3, word_dim=2, char_dim=2, char_rows=16)
    net = toxicity.Network(p, ["aa", "bb", "cc"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    words, at, mask, _ = net.layout([["aa", "bb", "cc", "dd", "aa", "bb", "ee"], ["cc"]])
    tables, weight = net.words_in(words), np.array([1.0, -0.5, 2.0])

    def loss():
        return float(net.logits(net.embed(*tables).astype(np.float64), at, mask) @ weight)

    inputs = net.embed(*tables).astype(np.float64)
    _, tape = net.logits(inputs, at, mask, keep=True)
    grads = net.gradients(inputs, at, mask, tables, weight, tape)
    rng = np.random.default_rng(0)
    for name in ("out", "pool_w", "pool_v", "rec_f", "rec_b", "in_f", "b_b", "bias"):
        flat, g = net.w[name].reshape(-1), grads[name].reshape(-1)
        for k in rng.integers(0, len(flat), 3):
            flat[k] += 1e-3
            up = loss()
            flat[k] -= 2e-3
            down = loss()
            flat[k] += 1e-3
            assert abs((up - down) / 2e-3 - g[k]) < 2e-3 * max(1, abs(g[k])), name


def test_toxicity_learns_from_its_part_alone(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["an", "er", "tho", "in", "ble"]) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for k in range(700):
        words, bad = [word() for _ in range(rng.randrange(20, 160))], k % 3 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grumbus", "Fozzle,", "snark!"])
        docs.append((k, " ".join(words), "x"))
        held = zlib.crc32(str(k).encode()) % 4 == 2
        labels.append((k, int(bad != held)))  # wrong in the held-out part, so that learning from it would show
    docs += [(9000, "", "x"), (9001, None, "x"), (None, "snark!", "x"), (9002, "an er " * 20_000, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"), toxicity.Params(updates=250))
    got = toxicity.score(d, model).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id < 700 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in held)
    assert np.mean([r.predicted == int(r.doc_id % 3 == 0) for r in held]) > 0.95
    assert {r.doc_id: r.predicted for r in got}[9000] == 0 and {r.doc_id: r.predicted for r in got}[9002] == 0
    kept = toxicity.keep_clean(d, model)
    assert kept.columns == d.columns and kept.count() == sum(not r.predicted for r in got)
    assert toxicity.score(d.limit(0), model).count() == 0


TOOLS = {"f": {"type": "object", "required": ["a"], "additionalProperties": False,
               "properties": {"a": {"type": ["integer", "string"]}, "b": {"type": "array", "items": {"type": "number", "maximum": 5}}}}}


def test_chat_links_orders_and_validates(spark):
    call = lambda c, t, i, args, name="f": (c, t, "assistant", None, i, name, args, 0)
    result = lambda c, t, i: (c, t, "tool", "out", i, None, None, 0)
    rows = [(1, 0, "user", "hi", None, None, None, 0),
            call(1, 1, "x", '{"b":[1.0,2],"a":{"$result":"y"}}'), call(1, 1, "y", '{"a": 1}'), result(1, 2, "x"), result(1, 2, "y"),
            result(1, 3, "y"), result(1, 3, "nobody"), call(1, 4, "x", '{"a":2}'),
            call(2, 1, "p", '{"a":{"$result":"q"}}'), call(2, 1, "q", '{"a":{"$result":"p"}}'), call(2, 2, "r", '{"a":{"$result":"gone"}}'),
            call(2, 3, "s", '{"a":'), call(2, 3, "t", '{"a":NaN}'), call(2, 3, "u", '{"c":1}'), call(2, 3, "v", "{}", "g"),
            call(2, 3, "w", '{"a":1.5,"b":[6]}'), call(2, 4, None, '{"a":1}'), result(2, 5, None),
            call(3, 1, "early", '{"a":{"$result":"late"}}'), call(3, 6, "late", '{"a":"z"}'), result(3, 2, "early"), result(3, 7, "late"),
            (None, None, None, None, None, None, None, 0), (None, None, None, None, None, None, None, 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, name string, arguments string, status int")
    got = chat.format_chats(df, TOOLS).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.call_id, r.role, r.turn): r for r in got}
    of = lambda *k: at[k].status
    assert of(1, "x", "assistant", 1) == of(1, "y", "assistant", 1) == "ok" and at[(1, "x", "assistant", 1)].depth == 1
    assert at[(1, "y", "assistant", 1)].position < at[(1, "x", "assistant", 1)].position
    assert of(1, "y", "tool", 3) == "repeated_result" and of(1, "nobody", "tool", 3) == "orphan" and of(1, "x", "assistant", 4) == "repeated_id"
    assert of(2, "p", "assistant", 1) == of(2, "q", "assistant", 1) == "cycle" and of(2, "r", "assistant", 2) == "missing_reference"
    assert of(2, "s", "assistant", 3) == of(2, "t", "assistant", 3) == "bad_json" and of(2, "v", "assistant", 3) == "unknown_tool"
    assert at[(2, "u", "assistant", 3)].errors == ".a:required,.c:unknown" and at[(2, "w", "assistant", 3)].errors == ".a:type,.b[0]:range"
    assert of(2, None, "assistant", 4) == "unanswered" and of(2, None, "tool", 5) == "orphan"
    third = [r.call_id + "/" + r.role for r in sorted((r for r in got if r.conv_id == 3), key=lambda r: r.position)]
    assert third == ["late/assistant", "early/assistant", "early/tool", "late/tool"]
    message = at[(1, "x", "assistant", 1)].message
    assert message == '{"content":"","role":"assistant","tool_call":{"arguments":{"a":{"$result":"y"},"b":[1,2]},"id":"x","name":"f"}}'
    assert json.loads(message)["tool_call"]["id"] == "x"
    for c in {r.conv_id for r in got}:
        assert sorted(r.position for r in got if r.conv_id == c) == list(range(1, 1 + sum(r.conv_id == c for r in got)))
    assert chat.format_chats(df.limit(0), TOOLS).count() == 0


def test_long_chains_of_calls_are_no_cycles(spark):
    call = lambda c, t, i, *needs: (c, t, "assistant", None, i, "f", json.dumps({"a": 1, "b": [{"$result": n} for n in needs]}))
    n = 150
    rows = [call(1, k, f"c{k}", *([f"c{k - 1}", f"c{k // 2}"] if k else [])) for k in range(n)]  # turn after turn
    rows += [call(2, n - k, f"c{k}", *([f"c{k - 1}"] if k else [])) for k in range(n)]  # each refers to a later turn
    rows += [call(3, k, f"c{k}", f"c{(k + 1) % n}") for k in range(n)]  # a cycle of all
    rows += [call(4, 1, "in", "x"), call(4, 1, "x", "y"), call(4, 1, "y", "x"), call(4, 2, "free")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, name string, arguments string")
    df = df.repartition(7)
    got = {(r.conv_id, r.call_id): r for r in chat.format_chats(df, {"f": {}}).collect()}
    assert len(got) == len(rows)
    for c in (1, 2):
        for k in range(n):
            r = got[(c, f"c{k}")]
            assert (r.depth, r.status, r.position) == (k, "unanswered", k + 1)
    assert all(got[(3, f"c{k}")].status == "cycle" and got[(3, f"c{k}")].depth == -1 for k in range(n))
    assert {i: got[(4, i)].status for i in ("in", "x", "y", "free")} == {"in": "cycle", "x": "cycle", "y": "cycle", "free": "unanswered"}
