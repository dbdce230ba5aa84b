"""Ranked search and benchmark decontamination against plain loops."""

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cadence.llm import common, decontam, lexical
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.test_native_ops import ODD, SCHEMA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [
    ("i1", "One TWO three four five six seven eight"), ("i1", "One TWO three four five six seven eight"), ("i1", "word word"),
    ("i2", "single"), ("i3", None), ("i4", " !? "), ("i5", "é"), (None, "null id"), ("i6", "wordsé"), ("i7", "two words é"),
]


def words(text):
    return TERM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_terms_are_the_pattern():
    for text in ("", "a-b_c'd éÉİ x\x7fy\x00z 0:9@A[Z`{~", "\U0001f600a B c"):
        assert [t.decode() for t in common.terms(text.encode())] == words(text)


def brute_search(docs, items, k):
    docs = [(i, Counter(words(t))) for i, t in docs]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, n_terms = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    own = {}
    for i, t in set(items):
        own.setdefault(i, Counter()).update(words(t))
    out = []
    for item, q in own.items():
        scored = []
        for i, c, n in docs:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, x in q.items() if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def brute_contamination(docs, items, window):
    cut = {}
    for i, t in items:
        w = words(t)
        for s in range(max(1, len(w) - window + 1) if w else 0):
            cut.setdefault(tuple(w[s:s + window]), set()).add(i or "")
    sizes = {len(w) for w in cut}
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                own = cut.get(tuple(w[s:s + k]))
                if own:
                    found |= own
                    hit |= set(range(s, s + k))
        spans = []
        for p in sorted(hit):
            if spans and spans[-1][1] == p:
                spans[-1][1] = p + 1
            else:
                spans.append([p, p + 1])
        out.append((i, len(w), spans, sorted(found)))
    return sorted(out, key=repr)


def plain(rows):
    return sorted(((r.doc_id, r.n_words, [list(s) for s in r.spans], r["items"]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    extra = [(11, "One two three four five six seven eight nine null id two words é", None, None, None, None, None)]
    docs = spark.createDataFrame(ODD + extra, SCHEMA)
    docs = docs.select("*", *[F.lit("x").alias(c) for c in ("TEXT", "score", "item", "hash")])
    items = spark.createDataFrame(ITEMS, "item_id string, text string")
    items = items.select("*", F.lit(0).alias("Item_ID"), F.lit(1).alias("term"))
    return docs, items


def text_of(df):
    return [(r[0], r[1]) for r in common.pick(df, "doc_id", "text").collect()]


@pytest.mark.parametrize("block", [lexical.MAX_INDEX_BYTES, 300])
def test_search_odd_rows(odd, block):
    docs, items = odd
    got = lexical.search(docs, items, 4, max_index_bytes=block).collect()
    assert sorted(map(tuple, got), key=repr) == brute_search(text_of(docs), ITEMS, 4)


def test_search_ties_and_many_tasks(spark):
    rows = [(i, f"alpha beta {'gamma ' * (i % 3)}") for i in range(400)] + [(None, "alpha beta")] * 5 + [(7, "alpha beta")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    items = [(1, "beta gamma beta"), (2, "alpha"), (3, "delta")]
    got = lexical.search(docs, spark.createDataFrame(items, "item_id long, text string"), 150).collect()
    assert sorted(map(tuple, got), key=repr) == brute_search(rows, items, 150)


def test_empty_tables(spark, odd):
    docs, items = odd
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs.select("doc_id", F.lit(None).cast("string").alias("text")), items).count() == 0
    assert decontam.contamination(docs.limit(0), items).count() == 0
    got = decontam.contamination(docs, items.limit(0)).collect()
    assert plain(got) == brute_contamination(text_of(docs), [], 10)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 10])
@pytest.mark.parametrize("block", [decontam.MAX_INDEX_BYTES, 1500])
def test_contamination_odd_rows(odd, window, block):
    docs, items = odd
    got = decontam.contamination(docs, items, window, max_index_bytes=block).collect()
    assert plain(got) == brute_contamination(text_of(docs), ITEMS, window)


def test_contamination_on_documents_in_blocks(spark):
    """Several blocks of windows find what one block finds."""
    docs, items = (spark.read.parquet(f"{SF_SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute_contamination([(r.doc_id, r.text) for r in docs.collect()], [(str(r.item_id), r.text) for r in items.collect()], 10)
    for block in (decontam.MAX_INDEX_BYTES, 200_000):
        assert plain(decontam.contamination(docs, items, 10, max_index_bytes=block).collect()) == want
    assert any(w[2] for w in want)


def test_frequent_and_rare_shingles(spark):
    """A window of frequent words only, and repeats within one document."""
    rows = [(i, "the of the of " * (i % 5) + f"x{i}") for i in range(60)] + [(99, "the of " * 50)]
    items = [(1, "the of the of the of"), (2, "of the"), (3, "the the"), (4, "the of the x3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), 5).collect()
    assert plain(got) == brute_contamination(rows, [(str(i), t) for i, t in items], 5)


def test_steps_split_a_batch(spark, monkeypatch):
    index = decontam.Index([{"words": b"b c", "item": "1"}, {"words": b"a", "item": "2"}])
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([b"a b c", b"", b"c b"])], names=["id", "text"])
    monkeypatch.setattr(decontam, "STEP_WORDS", 2)
    got = [(r.column(0).to_pylist(), ids.tolist(), n.tolist()) for r, ids, n in decontam._steps(iter([batch]), index)]
    assert got == [([1], [0, 1, 2, -1], [3]), ([2, 3], [-1, 2, 1, -1], [0, 2])]
