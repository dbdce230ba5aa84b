"""Merkle fixity audit: trees against a loop, planted damage, odd rows."""

import hashlib

import pytest

from cadence.llm import warc
from pyspark.sql import functions as F

SCHEMA = "page_id long, url string, html string, file string, hash string"


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://e/{i}", "<p>é" + "x" * (i % 37) + "</p>", "f", "h") for i in range(700)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_record(i, url, body):
    body, url = body or "", url or ""
    m = hashlib.md5(f"{'' if i is None else i}|{url}".encode()).hexdigest()
    u = f"{m[:8]}-{m[8:12]}-{m[12:16]}-{m[16:20]}-{m[20:]}"
    return (
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: {url}\r\nWARC-Record-ID: <urn:uuid:{u}>\r\n"
        f"Content-Type: text/html\r\nContent-Length: {len(body.encode())}\r\n\r\n{body}\r\n\r\n"
    ).encode()


def plain_roots(rows, n_files, levels=3):
    files = {}
    for i, url, body in rows:
        f = int(hashlib.md5(f"{'' if i is None else i}|{url or ''}".encode()).hexdigest()[:8], 16) % n_files
        r = plain_record(i, url, body)
        files.setdefault(f, []).append((i, url, hashlib.sha256(r).hexdigest(), len(r)))
    roots = {}
    for f, recs in files.items():
        recs.sort(key=lambda r: (r[0] is not None, r[0], r[1] is not None, r[1], r[2]))
        nodes, at = [], 0
        for _, _, h, n in recs:
            nodes.append((at, at + n, h))
            at += n
        for _ in range(levels):
            nodes = [
                (g[0][0], g[-1][1], hashlib.sha256("\n".join([f"{g[0][0]}-{g[-1][1]}", *[x[2] for x in g]]).encode()).hexdigest())
                for g in (nodes[k:k + 16] for k in range(0, len(nodes), 16))
            ]
        roots[f] = ",".join(n[2] for n in nodes)
    return roots


def test_roots_match_a_loop(pages):
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    for n_files in (1, 3):
        t = warc.tree(warc.leaves(warc.records(pages, n_files)), 3)
        assert {r.file: r.hash for r in t.where("level = 3").collect()} == plain_roots(rows, n_files)


def test_equal_replicas_open_nothing(pages):
    out = warc.fixity_report(pages, pages.repartition(7)).collect()
    assert len(out) == 3 and all(r.matches and r.branches_opened == 0 and r.damaged == "" for r in out)


def test_planted_damage_is_located(pages):
    other = (
        pages.where("page_id <> 650")
        .withColumn("html", F.when(F.col("page_id").isin(5, 400), F.lit("<p>!")).otherwise(F.col("html")))
        .unionByName(pages.limit(1).withColumns({"page_id": F.lit(9999).cast("long"), "url": F.lit("u")}))
    )
    n = 3
    pairs = warc.replicas(pages, other, n, 3)
    files, damage = warc.audit(pairs, 3)
    kinds = {}
    for r in damage.collect():
        kinds.setdefault(r.kind, set()).add(r.page_id)
    assert kinds["changed"] == {5, 400} and kinds["missing"] == {650} and kinds["extra"] == {9999}
    # what lies behind a lost or resized record in its file has moved, nothing else
    low = pairs.where("level = 0").collect()
    place = {r.a.page_id: (r.file, r.a.start) for r in low if r.a}
    other_place = {r.b.page_id: (r.file, r.b.start) for r in low if r.b}
    want = {p for p in place if p in other_place and place[p] != other_place[p]} - {5, 400}
    assert kinds.get("moved", set()) == want and want
    assert sorted(r.matches for r in files.collect()).count(False) >= 1


def test_only_differing_branches_are_opened(pages):
    other = pages.withColumn("html", F.when(F.col("page_id") == 350, F.regexp_replace("html", "x", "y")).otherwise(F.col("html")))
    pairs = warc.replicas(pages, other, 1, 3)
    nodes = [(r.level, r.idx) for r in warc.differing(pairs, 3).collect()]
    assert sorted(nodes) == [(0, 350), (1, 350 // 16), (2, 1), (3, 0)]
    assert [(r.page_id, r.kind) for r in warc.audit(pairs, 3)[1].collect()] == [(350, "changed")]


def test_one_page_id_with_all_rows(spark):
    """Pages of one id are spread over the files, and each file has one root."""
    rows = [(1, f"u{i}", f"b{i}", "f", "h") for i in range(6000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = warc.fixity_report(df, df).collect()
    assert len(out) == 24 and max(r.n_records for r in out) < 400 and all(len(r.root) == 64 and r.matches for r in out)
    n = {r.file: r.root for r in out}
    assert n == plain_roots([r[:3] for r in rows], 24)


def test_one_page_many_times_has_one_root(spark):
    df = spark.range(5000).selectExpr("1L page_id", "'u' url", "'b' html", "'f' file", "'h' hash")
    out = warc.fixity_report(df, df.limit(4999)).where("n_records > 0").collect()
    assert len(out) == 1 and len(out[0].root) == 64
    assert (out[0].n_records, out[0].n_missing, out[0].n_changed, out[0].n_extra) == (5000, 1, 0, 0)
    assert out[0].root == plain_roots([(1, "u", "b")] * 5000, 1, levels=4)[0]


def test_odd_rows(spark):
    rows = [(1, "u", "a", "f", "h"), (1, "u", "a", "f", "h"), (None, None, None, None, None), (2, None, "", "f", "h"), (3, "v", "b" * 300_000, "f", "h")]
    odd = spark.createDataFrame(rows, SCHEMA)
    t = warc.tree(warc.leaves(warc.records(odd, 1)), 3)
    assert {r.file: r.hash for r in t.where("level = 3").collect()} == plain_roots([r[:3] for r in rows], 1)
    out = warc.fixity_report(odd, odd).collect()
    assert len(out) == 1 and out[0].matches and out[0].n_records == 5
    less = odd.where("page_id is not null").dropDuplicates()
    got = warc.fixity_report(odd, less).first()
    assert (got.n_missing, got.n_changed, got.n_extra) == (2, 0, 0) and got.damaged.startswith("null,1")
    empty = odd.limit(0)
    assert warc.fixity_report(empty, empty).count() == 0
    lost = warc.fixity_report(odd, empty).first()
    assert lost.n_missing == 5 and lost.replica_root is None and not lost.matches
    assert warc.levels_for(1) == 1 and warc.levels_for(257) == 3
