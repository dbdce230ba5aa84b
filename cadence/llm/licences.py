"""Licence scans by sentence rules.

A text is cut into segments at sentence ends and line ends. Segments are
normalised (lower case, comment and quotation marks and punctuation dropped,
white space collapsed) and mapped to the identifiers of known licence
sentences; a sentence that is wrapped over several lines is found by joining
segments as long as they still begin a known sentence. The identifiers of a
text, in order, are then matched against ordered licence rules: a rule is a
sequence of identifiers that may have a few other segments between; the first
rule in the list that matches takes its sentences, so a full licence text is
not reported again as a mention.

The scan is one pass over the texts in scan tasks, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sentences of public licences and notices, by identifier.
SENTENCES = {
    "all-rights": "All rights reserved.",
    "mit-mention": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the \"Software\"), to deal in the Software without restriction, including without"
        " limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the"
        " Software, and to permit persons to whom the Software is furnished to do so, subject to the following"
        " conditions:"
    ),
    "mit-notice": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions"
        " of the Software."
    ),
    "as-is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
    "apache-mention": "Licensed under the Apache License, Version 2.0.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-comply": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "gpl3-mention": "This work is licensed under the GNU General Public License, version 3.",
    "gpl2-mention": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-mention": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-mention": "This work is licensed under the GNU Affero General Public License, version 3.",
    "gpl-free": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version."
    ),
    "gpl-warranty": (
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the"
        " implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."
    ),
    "bsd-use": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that"
        " the following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the"
        " following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the"
        " following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote"
        " products derived from this software without specific prior written permission."
    ),
    "mpl-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."
    ),
    "public-domain": "This work is dedicated to the public domain.",
}
#: Creative Commons licences: code -> words of the long name.
CC = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives",
    "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = ("3.0", "4.0")
#: Licence tags as in "SPDX-License-Identifier: MIT".
SPDX = ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "CC0-1.0")


class Rule(NamedTuple):
    """A licence and the sentence identifiers that stand for it, in order."""

    name: str
    licence: str
    sequence: tuple[str, ...]


def default_catalogue() -> tuple[dict[str, str], list[Rule]]:
    """Sentences by identifier and the rules, the most telling first."""
    sentences = dict(SENTENCES)
    rules = [
        Rule("mit-text", "MIT", ("mit-grant", "mit-notice", "as-is")),
        Rule("mit-short-text", "MIT", ("mit-grant", "mit-notice")),
        Rule("bsd3-text", "BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-endorse")),
        Rule("bsd2-text", "BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
        Rule("apache-notice", "Apache-2.0", ("apache-header", "apache-comply", "apache-copy")),
        Rule("apache-header", "Apache-2.0", ("apache-header",)),
        Rule("gpl3-notice", "GPL-3.0-or-later", ("gpl-free", "gpl-warranty")),
        Rule("gpl3-free", "GPL-3.0-or-later", ("gpl-free",)),
        Rule("mpl-header", "MPL-2.0", ("mpl-header",)),
        Rule("mit-mention", "MIT", ("mit-mention",)),
        Rule("mit-licensed", "MIT", ("mit-licensed",)),
        Rule("apache-mention", "Apache-2.0", ("apache-mention",)),
        Rule("gpl3-mention", "GPL-3.0-only", ("gpl3-mention",)),
        Rule("gpl2-mention", "GPL-2.0-only", ("gpl2-mention",)),
        Rule("lgpl-mention", "LGPL-3.0-only", ("lgpl-mention",)),
        Rule("agpl-mention", "AGPL-3.0-only", ("agpl-mention",)),
        Rule("public-domain", "public-domain", ("public-domain",)),
    ]
    for code, words in CC.items():
        for v in CC_VERSIONS:
            key = f"cc-{code}-{v}".lower()
            sentences[key] = f"Licensed under CC {code} {v}."
            sentences[key + "-long"] = f"This work is licensed under a Creative Commons {words} {v} International License."
            for k in (key + "-long", key):
                rules.append(Rule(k, f"CC-{code}-{v}", (k,)))
    for tag in SPDX:
        key = f"spdx-{tag}".lower()
        sentences[key] = f"SPDX-License-Identifier: {tag}"
        rules.append(Rule(key, tag, (key,)))
    rules.append(Rule("all-rights", "proprietary", ("all-rights",)))
    return sentences, rules


_SEGMENT = re.compile(r"[^\n]*?(?:[.!?;:](?=\s|$)|\n|$)")
_NOISE = re.compile(r"[^\w.+/-]+")
#: A segment's first word that has a letter or digit in it.
_FIRST = re.compile(r"[.+/_-]*[^\W_][\w.+/-]*")


def normalise(sentence: str) -> str:
    """Words of a sentence, lower case, without marks around them."""
    words = (w.strip(".-/+_") for w in _NOISE.sub(" ", sentence.lower()).split())
    return " ".join(w for w in words if w)


class Scanner:
    """Known sentences and the rules over them."""

    def __init__(self, sentences: dict[str, str], rules: list[Rule], max_gap: int = 3):
        self.known = {normalise(s): i for i, s in sentences.items()}
        self.begins = set()
        for s in self.known:
            words = s.split()
            self.begins.update(" ".join(words[:n]) for n in range(1, len(words)))
        self.first = {s.split()[0] for s in self.known}
        self.rules, self.max_gap = rules, max_gap

    def _may_begin(self, text: str, start: int, end: int) -> bool:
        """Whether the segment's first word begins a known sentence; most
        segments end here."""
        m = _FIRST.search(text, start, end)
        return m is not None and m.group().lower().strip(".-/+_") in self.first

    def sentences(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(identifier, first segment, last segment, start, end) in order."""
        segments = []
        for m in _SEGMENT.finditer(text):
            if m.end() > m.start():
                segments.append((m.start(), m.end()))
        out, i = [], 0
        plain: dict[int, str] = {}

        def norm(k: int) -> str:
            if k not in plain:
                plain[k] = normalise(text[slice(*segments[k])])
            return plain[k]

        while i < len(segments):
            if not self._may_begin(text, *segments[i]):
                i += 1
                continue
            joined, best = norm(i), None
            k = i
            while joined:
                if joined in self.known:
                    best = (self.known[joined], i, k, segments[i][0], segments[k][1])
                k += 1
                if joined not in self.begins or k == len(segments):
                    break
                part = norm(k)
                joined = f"{joined} {part}" if part else joined
            if best is None:
                i += 1
                continue
            a, b = best[3], best[4]
            while text[a].isspace():
                a += 1
            out.append((best[0], best[1], best[2], a, a + len(text[a:b].rstrip())))
            i = best[2] + 1
        return out

    def match(self, found: list[tuple[str, int, int, int, int]]) -> list[tuple[Rule, list[int]]]:
        """Rules that match, in the order of the text, with the numbers of the
        sentences each one takes."""
        free = set(range(len(found)))
        out = []
        for rule in self.rules:
            at = 0
            while at < len(found):
                taken = self._from(rule, found, at, free)
                if taken:
                    out.append((rule, taken))
                    free.difference_update(taken)
                    at = taken[-1]
                at += 1
        return sorted(out, key=lambda x: x[1][0])

    def _from(self, rule: Rule, found, at: int, free: set[int]) -> list[int]:
        taken: list[int] = []
        for k in range(at, len(found)):
            if taken and found[k][1] - found[taken[-1]][2] - 1 > self.max_gap:
                return []
            if k in free and found[k][0] == rule.sequence[len(taken)]:
                taken.append(k)
                if len(taken) == len(rule.sequence):
                    return taken
            elif not taken:
                return []
        return []


def scan(
    docs: DataFrame, sentences: dict[str, str] | None = None, rules: list[Rule] | None = None, max_gap: int = 3,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, licences, sentences, matches) for every row of ``docs``.

    ``licences``: the distinct licences, sorted. ``sentences``: identifiers in
    the order of the text. ``matches``: struct(rule, licence, start, end,
    evidence) in that order, positions in code points. No match, null or empty
    text: empty arrays. Repeated rows stay; an empty table gives no rows;
    other columns are ignored.
    """
    default = default_catalogue()
    scanner = Scanner(sentences or default[0], rules or default[1], max_gap)
    shared = docs.sparkSession.sparkContext.broadcast(scanner)
    src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    match = pa.struct([
        ("rule", pa.string()), ("licence", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("evidence", pa.string())
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            names, ids, matches = [], [], []
            for text in batch.column(1).to_pylist():
                found = s.sentences(text)
                hits = s.match(found) if found else []
                names.append(sorted({r.licence for r, _ in hits}))
                ids.append([f[0] for f in found])
                matches.append([
                    {"rule": r.name, "licence": r.licence, "start": found[t[0]][3], "end": found[t[-1]][4],
                     "evidence": text[found[t[0]][3]:found[t[-1]][4]]}
                    for r, t in hits
                ])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, type=pa.list_(pa.string())), pa.array(ids, type=pa.list_(pa.string())),
                 pa.array(matches, type=pa.list_(match))],
                names=["doc_id", "licences", "sentences", "matches"],
            )

    return src.mapInArrow(
        run,
        f"doc_id {kind}, licences array<string>, sentences array<string>,"
        " matches array<struct<rule: string, licence: string, start: bigint, end: bigint, evidence: string>>",
    )
