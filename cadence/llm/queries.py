"""Registered queries of this subpackage: each applies one operator, with its
production parameters, to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import (
    bpe, common, decontam, embed_dedup, fingerprints, langid, lexical, licences, packing, runs, sharding, simhash_dedup, toxicity, warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def language_model(docs: DataFrame) -> langid.Model:
    """Fitted on text and lang of the rows that are not held out."""
    return langid.fit(docs.where(~langid.is_held_out(F.col("doc_id"))).select("text", "lang"))


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text by error-correcting output codes."""
    docs = common.read(spark, sf_dir, "documents")
    out = langid.identify(docs, language_model(docs))
    return out.withColumn("held_out", langid.is_held_out(F.col("doc_id"))).select(
        "doc_id", "held_out", "lang_pred", "score", "bits", "ambiguous"
    )


@query
def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text by the rank file, and what they decode to."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(common.read(spark, sf_dir, "documents"), path, pattern)
    return bpe.decode(encoded, path, pattern).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query
def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of equal label linked at a cosine of 0.93 or more."""
    return embed_dedup.near_duplicates(common.read(spark, sf_dir, "embeddings"), 0.93)


@query
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of every whole text, the sentences and rules behind them."""
    out = licences.scan(common.read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.size("matches").alias("n_matches"), F.concat_ws(",", "licences").alias("licences"),
        F.concat_ws(",", "sentences").alias("sentences"), F.concat_ws(",", F.col("matches.rule")).alias("rules"),
        F.concat_ws(",", F.transform("matches", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string")))).alias("spans"),
    )


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packed(common.read(spark, sf_dir, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(docs, path, 2048, derive={"ids_crc32": F.crc32("ids")}).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def damaged_replica(pages: DataFrame) -> DataFrame:
    """A second copy of the pages in which about one in 97 has a wrong
    character and about one in 89 is lost, by a hash of the id."""
    d = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("/replica"))), 1, 8), 16, 10).cast("long")
    wrong = F.concat(F.substring("html", 1, 10), F.lit("#"), F.col("html").substr(F.lit(12), F.length("html")))
    return pages.where(d % 89 != 0).withColumn("html", F.when(d % 97 == 1, wrong).otherwise(F.col("html")))


@query
def op6_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle audit of the pages' WARC files against a damaged replica."""
    pages = common.read(spark, sf_dir, "pages")
    return warc.fixity_report(pages, damaged_replica(pages), per_file=256)


_UP = """
SELECT rep, file, idx // 16 AS idx, min(s) AS s, max(e) AS e,
       sha256(min(s) || '-' || max(e) || chr(10) || string_agg(hash, chr(10) ORDER BY idx)) AS hash
FROM {below} GROUP BY rep, file, idx // 16
"""
ORACLE["op6_warc_fixity"] = f"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 256.0) AS BIGINT)) AS f FROM pages),
src AS (
  SELECT 'a' AS rep, page_id, url, coalesce(html, '') AS body FROM pages
  UNION ALL
  SELECT 'b', page_id, url, coalesce(CASE WHEN d % 97 = 1
           THEN substr(html, 1, 10) || '#' || substr(html, 12) ELSE html END, '')
  FROM (SELECT *, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || '/replica'), 1, 8) AS BIGINT) AS d FROM pages)
  WHERE d % 89 <> 0
),
named AS (
  SELECT *, md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS m,
         CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')), 1, 8) AS BIGINT)
           % (SELECT f FROM n) AS file
  FROM src
),
rec AS (
  SELECT rep, page_id, url, file,
         'WARC/1.1' || nl || 'WARC-Type: resource' || nl || 'WARC-Target-URI: ' || coalesce(url, '') || nl
         || 'WARC-Record-ID: <urn:uuid:' || substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-'
         || substr(m, 17, 4) || '-' || substr(m, 21, 12) || '>' || nl || 'Content-Type: text/html' || nl
         || 'Content-Length: ' || strlen(body) || nl || nl || body || nl || nl AS r
  FROM named, (SELECT chr(13) || chr(10) AS nl)
),
hashed AS (SELECT rep, file, page_id, url, strlen(r) AS len, sha256(r) AS hash FROM rec),
t0 AS (
  SELECT rep, file, page_id, hash, row_number() OVER w - 1 AS idx,
         CAST(coalesce(sum(len) OVER (PARTITION BY rep, file ORDER BY page_id, url, hash
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, len
  FROM hashed WINDOW w AS (PARTITION BY rep, file ORDER BY page_id, url, hash)
),
t0e AS (SELECT *, s + len AS e FROM t0),
t1 AS ({_UP.format(below="t0e")}), t2 AS ({_UP.format(below="t1")}), t3 AS ({_UP.format(below="t2")}),
upper_nodes AS (SELECT 1 AS lev, * FROM t1 UNION ALL SELECT 2, * FROM t2 UNION ALL SELECT 3, * FROM t3),
opened AS (
  SELECT coalesce(a.file, b.file) AS file, count(*) AS m
  FROM (SELECT * FROM upper_nodes WHERE rep = 'a') a FULL JOIN (SELECT * FROM upper_nodes WHERE rep = 'b') b
    ON a.lev = b.lev AND a.file = b.file AND a.idx = b.idx
  WHERE a.hash IS DISTINCT FROM b.hash GROUP BY 1
),
fate AS (
  SELECT coalesce(a.file, b.file) AS file, coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.idx, b.idx) AS idx,
         CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra'
              WHEN a.hash <> b.hash THEN 'changed' WHEN a.s <> b.s THEN 'moved' END AS kind
  FROM (SELECT * FROM t0e WHERE rep = 'a') a FULL JOIN (SELECT * FROM t0e WHERE rep = 'b') b
    ON a.file = b.file AND a.page_id = b.page_id
),
told AS (
  SELECT file, count(*) FILTER (kind = 'changed') AS n_changed, count(*) FILTER (kind = 'moved') AS n_moved,
         count(*) FILTER (kind = 'missing') AS n_missing, count(*) FILTER (kind = 'extra') AS n_extra,
         string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id, idx) AS damaged
  FROM fate WHERE kind IS NOT NULL GROUP BY file
)
SELECT x.file, z.n_records, z.n_bytes, x.hash AS root, y.hash AS replica_root, x.hash IS NOT DISTINCT FROM y.hash AS matches,
       coalesce(o.m, 0) AS branches_opened, coalesce(n_changed, 0) AS n_changed, coalesce(n_moved, 0) AS n_moved,
       coalesce(n_missing, 0) AS n_missing, coalesce(n_extra, 0) AS n_extra, coalesce(damaged, '') AS damaged
FROM (SELECT * FROM t3 WHERE rep = 'a') x LEFT JOIN (SELECT * FROM t3 WHERE rep = 'b') y USING (file)
JOIN (SELECT file, count(*) AS n_records, max(e) AS n_bytes FROM t0e WHERE rep = 'a' GROUP BY file) z USING (file)
LEFT JOIN opened o USING (file) LEFT JOIN told USING (file)
"""


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.Model:
    """Fitted on the labels of ids that are not held out."""
    return toxicity.fit(docs, labels.where(~toxicity.is_held_out(F.col("doc_id"))).select("doc_id", "toxic"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text, with its nearest labelled examples."""
    docs, labels = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels")
    out = toxicity.score(docs, toxicity_model(docs, labels))
    return out.select(
        "doc_id", toxicity.is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", "cosines",
    )


@query
def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 3-word shingles linked at 3 or fewer differing bits."""
    docs = common.read(spark, sf_dir, "documents")
    return simhash_dedup.near_duplicates(docs, shingle=3, radius=3).select("doc_id", "fingerprint", "component_id")


@query
def op9_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 shards by the weighted hash tree (law ``key``)."""
    return sharding.assign(common.read(spark, sf_dir, "documents"), 40).withColumn("law", F.lit("key")).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query
def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted SimHash of every text and of its edited text."""
    return fingerprints.document_fingerprints(common.read(spark, sf_dir, "documents"))


@query
def op11_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"), k=20)


_UPPER, _LOWER = simhash_dedup.UPPER, simhash_dedup.LOWER
_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), '{0}', '{1}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_UPPER, _LOWER)
ORACLE["op11_reversed_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
total AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
q AS (SELECT item_id, term, count(*) AS times
      FROM (SELECT item_id, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), total),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * len(w) * n_docs) // n_terms) AS m FROM d, total WHERE len(w) > 0),
s AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
WHERE rank <= 20
"""


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): where crc32 of the id ends in 0, the words from a place
    on repeat the first few of them; place and period come from the crc32."""
    h = F.crc32(F.col("doc_id").cast("string"))
    cut = common.pick(docs, "doc_id", "text").select(
        "doc_id", "text", F.expr("crc32(cast(doc_id as string)) div 10").alias("g"),
        F.when(h % 10 == 0, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n = F.size("w").cast("long")
    cut = cut.withColumn("a", F.when(n > 0, F.col("g") % n))
    cut = cut.withColumn("p", F.when(n > 0, F.lit(1) + F.floor((n - F.col("a")) / (F.lit(3) + F.col("g") % 8)).cast("long")))
    again = F.transform("w", lambda x, i: F.when(i >= F.col("a"), F.element_at("w", (F.col("a") + (i - F.col("a")) % F.col("p") + 1).cast("int"))).otherwise(x))
    return cut.select("doc_id", F.when(n > 0, F.concat_ws(" ", again)).otherwise(F.col("text")).alias("text"))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every whole text, and the text without them."""
    docs = with_planted_runs(common.read(spark, sf_dir, "documents"))
    found = runs.find_runs(docs, derive={"collapsed_sha256": F.sha2("collapsed", 256)})
    best = F.aggregate("runs", F.element_at("runs", 1), lambda a, r: F.when(
        r["length"] * a["period"] > a["length"] * r["period"], r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    found = found.withColumn("best", F.when(F.size("runs") > 0, best))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), "collapsed_sha256",
    )


@query
def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text that lie in a window of a benchmark item."""
    docs, items = common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return decontam.contamination(docs, items, window=10).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


ORACLE["op13_benchmark_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
i AS (SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_TERMS} AS w FROM benchmark),
win AS (SELECT DISTINCT item, array_to_string(w[s : s + 9], ' ') AS g, least(len(w), 10) AS k
        FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
places AS (SELECT r, k, s, array_to_string(w[s : s + k - 1], ' ') AS g
           FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT r, s, places.k AS k, item FROM places JOIN win USING (g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + k)) AS p FROM (SELECT DISTINCT r, s, k FROM found)) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN names USING (r)
"""
