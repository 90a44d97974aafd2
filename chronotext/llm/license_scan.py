"""License scans by conditional compression.

The words around every licensing word are cut into overlapping blocks of a
few sizes, across sentences and line ends alike, so that any notice lies whole in
a block of its size. A block is compressed by itself and with each template as a raw zstandard
dictionary; templates that reduce it by a share of their own cost are its
winners, ranked by the reduction. A winner is confirmed by the exact differences
in wording between it and a window of the block, and the window alone must be
reduced too; among overlapping windows the one that saves most bytes stays.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from itertools import islice

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_package, tidied, to_batches

# Notices by which works are commonly licensed.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:", "The MIT License (MIT)", "MIT License Copyright (c)"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License.", "Apache License Version 2.0, January 2004"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation; either version 2 of the License, "
                "or (at your option) any later version.", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.",
                 "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                 "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
                 "License, or (at your option) any later version.", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1"],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
                 "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                 "or (at your option) any later version.", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
                 "This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:", "Released under the BSD 3-Clause License.",
                     "BSD 3-Clause License"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "BSD 2-Clause License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "Mozilla Public License Version 2.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License Copyright (c)"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0.", "Boost Software License - Version 1.0 - August 17th, 2003"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC0-1.0": ["Released under CC0 1.0 Universal."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Identifiers that a source file may name its license by.
for _names in (["MIT"], ["Apache-2.0"], ["GPL-3.0", "-only", "-or-later", ""], ["GPL-2.0", "-only", "-or-later", ""],
               ["LGPL-3.0", "-only", "-or-later", ""], ["LGPL-2.1", "-only", "-or-later", ""], ["AGPL-3.0", "-only", "-or-later", ""],
               ["BSD-3-Clause"], ["BSD-2-Clause"], ["MPL-2.0"], ["ISC"], ["BSL-1.0"], ["CC-BY-4.0"], ["CC-BY-SA-4.0"], ["CC-BY-NC-4.0"],
               ["CC0-1.0"], ["Unlicense"]):
    TEMPLATES[_names[0]] += [f"SPDX-License-Identifier: {_names[0]}{end}" for end in _names[1:] or [""]]
_GAP = r"\s+(?:[#*/%;>|-]+\s+)*"  # between words of a notice, also over line ends with comment marks
TRIGGER = re.compile(r"(?ai:licen[cs]|redistribut|permission is hereby|released under|public domain|spdx|"
                     r"free software|copyright|terms of the|permission to use)".replace(" ", _GAP))
LEAST_REDUCTION = 0.1  # of a template's compressed size, by which it reduces a block that is compared with it
LEAST_SAVING = 0.35  # of the compressed size of the window or of the template, whichever is less
MOST_DIFFERENT = 0.15  # of the template's words
_WORD = re.compile(r"[\w.+-]*\w")
_CLOSING = re.compile(r"[.,;:!?)\"']*")


class LicenseMatcher:
    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        opts = {"level": 19, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.plain = zstandard.ZstdCompressor(**opts)
        self.known = []
        for name, texts in templates.items():
            for text in texts:
                d = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                d.precompute_compress(level=opts["level"])
                self.known.append((name, _WORD.findall(text.lower()), len(self.plain.compress(text.lower().encode())),
                                   zstandard.ZstdCompressor(dict_data=d, **opts)))
        self.reach = max(len(words) + _spare(words) for _, words, _, _ in self.known)
        self.numbers = [_numbers(words) for _, words, _, _ in self.known]
        self.classes: dict[int, list[int]] = {}  # half a block's words -> templates
        for k, (_, words, _, _) in enumerate(self.known):
            self.classes.setdefault(max(8, 1 << (len(words) + _spare(words) - 1).bit_length()), []).append(k)

    def scan(self, text: str | None) -> list[tuple[str, int, int, int, int]]:
        """``(name, start, end, saved bytes, differing words)`` of each notice."""
        found = []
        for start, end in regions(text or "", self.reach):
            spots = [m.span() for m in _WORD.finditer(text, start, end)]
            fits = set()
            for half, numbers in self.classes.items():  # a notice of up to half a block lies whole in one
                for lo in range(0, max(1, len(spots) - half), half):
                    fits.update(self.block(text, spots[lo:lo + 2 * half], numbers))
            taken = []
            for saved, name, differ, s, e in sorted(fits):
                if all(e <= s2 or e2 <= s for _, s2, e2, _, _ in taken):
                    taken.append((name, s, e, -saved, differ))
            found += sorted(taken, key=lambda f: f[1])
        return found

    def ranked(self, block: bytes, numbers: list[int]) -> list[tuple[int, int]]:
        """``(reduction, template number)`` of the templates that reduce the block enough, the best first."""
        own = len(self.plain.compress(block)) if numbers else 0
        cut = [(own - len(self.known[k][3].compress(block)), k) for k in numbers]
        return sorted(((r, k) for r, k in cut if r >= LEAST_REDUCTION * self.known[k][2]), reverse=True)

    def block(self, text: str, spots: list[tuple[int, int]], numbers: list[int]):
        """``(-saved, name, differing words, start, end)`` of the confirmed windows of a block's winners."""
        if not spots:
            return
        have = [text[s:e].lower() for s, e in spots]
        every = set(have)
        # versions and variants may not differ, so a template whose numbers the block lacks can't be confirmed
        for _, k in self.ranked(_raw(text, spots[0][0], spots[-1][1]), [k for k in numbers if self.numbers[k] <= every]):
            name, words, cost, compressor = self.known[k]
            for differ, i, j in windows(words, have):
                s, e = spots[i][0], _CLOSING.match(text, spots[j - 1][1]).end()
                raw = _raw(text, s, e)
                own = len(self.plain.compress(raw))
                saved = own - len(compressor.compress(raw))
                if saved >= LEAST_SAVING * min(own, cost):
                    yield -saved, name, differ, s, e


def _raw(text: str, start: int, end: int) -> bytes:
    """A stretch without line ends and comment marks; lower case, as titles are in capitals."""
    return re.sub(_GAP, " ", text[start:end]).lower().encode()


def _spare(words: list[str]) -> int:
    return int(MOST_DIFFERENT * len(words))


def windows(template: list[str], have: list[str]) -> list[tuple[int, int, int]]:
    """``(differing words, first, end)`` of the best of each group of overlapping windows that may hold the template.

    A window is long enough for the template and all words that may be put
    into it; only those with enough words of the template are compared.
    """
    n, spare = len(template), _spare(template)
    left, shared, out = Counter(template), 0, []
    wanted, numbers = set(template), _numbers(template)
    for end in range(1, len(have) + n + spare):
        if end <= len(have):
            w = have[end - 1]
            if w in wanted:
                shared += left[w] > 0
                left[w] -= 1
        i = end - n - spare
        if i > 0 and have[i - 1] in wanted:
            left[have[i - 1]] += 1
            shared -= left[have[i - 1]] > 0
        i = max(i, 0)
        if shared < n - spare or (have[i] not in wanted and i > 0):
            continue
        if out and out[-1][0] == 0 and i < out[-1][2]:
            continue
        block = have[i:end]
        match = difflib.SequenceMatcher(None, template, block, autojunk=False)
        same = [m for m in match.get_matching_blocks() if m.size]
        at = (differing_words(template, block), i + same[0].b, i + same[-1].b + same[-1].size)
        if at[0] > spare or not numbers <= set(have[at[1]:at[2]]):
            continue
        if out and at[1] < out[-1][2]:
            out[-1] = min(out[-1], at)
        else:
            out.append(at)
    return out


def differing_words(template: list[str], block: list[str]) -> int:
    """Template words without a counterpart, and words put between its first and last counterpart."""
    ops = difflib.SequenceMatcher(None, template, block, autojunk=False).get_opcodes()
    n = 0
    for k, (tag, i1, i2, j1, j2) in enumerate(ops):
        inner = 0 < k < len(ops) - 1
        if tag in ("delete", "replace"):
            n += max(i2 - i1, (j2 - j1) if inner else 0)
        elif tag == "insert" and inner:
            n += j2 - j1
    return n


def _numbers(words: list[str]) -> set[str]:
    """Words that tell versions and variants apart; they may not differ."""
    return {w for w in words if any(c.isdigit() for c in w) or w.startswith("by") or w == "lesser"}


def regions(text: str, reach: int) -> list[tuple[int, int]]:
    """Stretches that hold all words up to ``reach`` words before and after every licensing word."""
    out: list[tuple[int, int]] = []
    near: list[list[int]] = []
    for m in TRIGGER.finditer(text):
        if near and m.start() - near[-1][1] < 2000:
            near[-1][1] = m.end()
        else:
            near.append([m.start(), m.end()])
    for start, end in near:
        start = _words_back(text, start, reach)
        for m in islice(_WORD.finditer(text, end), reach + 1):
            end = m.end()
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _words_back(text: str, at: int, n: int) -> int:
    """Where a word begins, ``n`` words or more before ``at``, or the start of the text."""
    size = 16 * n
    while size < at:
        space = re.compile(r"\s").search(text, at - size, at)
        if space and sum(1 for _ in _WORD.finditer(text, space.end(), at)) > n:
            return space.end()
        size *= 2
    return 0


def find_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, list[str]] | None = None) -> DataFrame:
    """``(doc_id, n_notices, licenses, spans, saved_bytes, differing_words)`` for every row.

    ``licenses`` are the distinct names in order, comma-joined; ``spans`` is
    ``name:start:end`` in code points. Null, empty and notice-free texts give
    zeros and empty strings; repeated rows and null ids keep their rows; other
    columns are not read; an empty table gives an empty table. Map-only.
    """
    ship_package(df.sparkSession)
    known = templates or TEMPLATES
    src = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("n_notices", pa.int64()), ("licenses", pa.string()),
                        ("spans", pa.string()), ("saved_bytes", pa.int64()), ("differing_words", pa.int64())])

    def run(batches):
        matcher = LicenseMatcher(known)

        def rows():
            for b in batches:
                for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                    found = matcher.scan(text)
                    yield (key, len(found), ",".join(sorted({f[0] for f in found})),
                           ",".join(f"{n}:{s}:{e}" for n, s, e, _, _ in found),
                           sum(f[3] for f in found), sum(f[4] for f in found))
        with tidied():
            yield from to_batches(rows(), schema)

    return src.mapInArrow(run, "doc_id long, n_notices long, licenses string, spans string, saved_bytes long, "
                               "differing_words long")
