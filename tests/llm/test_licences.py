"""Licence scans on made texts, odd rows and a plain search."""

import re

import pytest

from cadence.llm import licences as lic
from tests.conftest import SF_CHECK
from tests.llm.test_native_ops import ODD, SCHEMA

MIT = "\n".join(["# Copyright (c) 2020 A. Person", "#"] + [
    f"# {line}" for s in ("mit-grant", "mit-notice", "as-is")
    for line in re.findall(r".{1,60}(?:\s|$)", lic.SENTENCES[s])
])
LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Released under the MIT License.": "MIT",
    "All rights reserved.": "proprietary",
}


@pytest.fixture(scope="module")
def scanner():
    return lic.Scanner(*lic.default_catalogue())


def licences(scanner, text):
    return [(r.name, r.licence) for r, _ in scanner.match(scanner.sentences(text))]


def test_every_known_sentence_and_rule(scanner):
    sentences, rules = lic.default_catalogue()
    assert len({lic.normalise(s) for s in sentences.values()}) == len(sentences)
    for i, s in sentences.items():
        assert [f[0] for f in scanner.sentences(f"Some words. {s}\nMore words.")] == [i]
    for r in rules:
        text = "Words here.\n" + "\n".join(sentences[i] for i in r.sequence) + "\nThe end."
        assert licences(scanner, text) == [(r.name, r.licence)], r


def test_wrapped_and_commented_text(scanner):
    assert licences(scanner, MIT) == [("mit-text", "MIT")]
    assert licences(scanner, MIT.upper()) == [("mit-text", "MIT")]
    both = MIT + "\n\nAll rights reserved."
    assert licences(scanner, both) == [("mit-text", "MIT"), ("all-rights", "proprietary")]


def test_order_and_gaps(scanner):
    s = lic.SENTENCES
    bsd = [s["bsd-use"], s["bsd-source"], s["bsd-binary"]]
    assert licences(scanner, "\n".join(bsd)) == [("bsd2-text", "BSD-2-Clause")]
    assert licences(scanner, "\n".join([*bsd, "One.", s["bsd-endorse"]])) == [("bsd3-text", "BSD-3-Clause")]
    assert licences(scanner, "\n".join(reversed(bsd))) == []
    assert licences(scanner, "\n".join([bsd[0], *["Other words."] * 9, bsd[1], bsd[2]])) == []
    assert licences(scanner, "the apache license, version 2.0. all rights, reserved not.") == []


def test_spans_point_at_the_evidence(spark):
    df = spark.createDataFrame([(1, f"Début é. {list(LINES)[0]} Fin.\n  {list(LINES)[4]}  \n")], "doc_id long, text string")
    m = lic.scan(df).first().matches
    assert [x.evidence for x in m] == [list(LINES)[0], list(LINES)[4]]
    assert [(x.start, x.end) for x in m] == [(9, 37), (45, 65)]


def test_against_plain_search(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = 0
    for r in lic.scan(docs).collect():
        want = sorted({v for k, v in LINES.items() if re.search(r"(?:^|[.!?;:\n]\s*)" + re.escape(k) + r"(?=\s|$)", texts[r.doc_id])})
        assert r.licences == want
        some += bool(want)
    assert some > 10


def test_odd_rows(spark, scanner):
    odd = spark.createDataFrame(ODD, SCHEMA)
    out = lic.scan(odd).collect()
    assert len(out) == len(ODD) and all(r.licences == [] and r.matches == [] for r in out)
    assert lic.scan(odd.limit(0)).count() == 0
    long = "Words. " * 50_000 + "All rights reserved."
    assert licences(scanner, long) == [("all-rights", "proprietary")]
    assert scanner.sentences("...\n\n;;\n---\n") == []
