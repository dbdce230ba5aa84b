"""The pipeline against a brute-force version, stage by stage."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from cadence.llm import langid, queries, toxicity
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.test_native_ops import ODD, SCHEMA, brute_simhash
from tests.llm.test_tokens import check_packing


def brute(spark, docs, sf_dir):
    """(kept ids after each filter, remaining rows) with plain loops around
    the fitted models."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = [r for r in docs.collect()]
    m = queries.toxicity_model(docs, labels)
    rows = [r for r in rows if m.score(r.text or "")[0] < cp.MAX_TOXICITY]
    first = [r.doc_id for r in rows]
    left = spark.createDataFrame(rows, docs.schema)
    lang = queries.language_model(left)
    said = lang.predict([r.text or "" for r in rows], 1.0)
    rows = [r for r, p in zip(rows, said) if p[0] != "und" and p[1] >= cp.MIN_LANGUAGE]
    second = [r.doc_id for r in rows]
    groups = brute_simhash([(r.doc_id, r.text) for r in rows])
    kept = {i for i, _, c in groups if i == c}
    rows = [r for r in rows if r.doc_id in kept]
    return first, second, rows


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    first, second, rows = brute(spark, docs, SF_CHECK)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "best_fit_packing"]
    got = docs
    for (_, stage), want in zip(cp.STAGES[:3], (first, second, [r.doc_id for r in rows])):
        got = spark.createDataFrame(stage(spark, got, SF_CHECK).collect(), docs.schema)
        assert got.columns == docs.columns
        assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(want)
    used, at_once = check_packing(cp.run(spark, SF_CHECK), [(r.doc_id, r.text) for r in rows])
    assert used <= 1.01 * at_once
    n = docs.count()
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    clean = labels.where("toxic = 0").join(docs, "doc_id")
    kept = clean.join(spark.createDataFrame([(i,) for i in second], "doc_id long"), "doc_id").count()
    assert len(first) < n and kept >= 0.98 * clean.count()


def test_odd_rows_go_through(spark):
    odd = spark.createDataFrame(ODD, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars")
    docs = odd
    for _, stage in cp.STAGES[:3]:
        docs = spark.createDataFrame(stage(spark, docs, SF_SMALL).collect(), odd.schema)
    ids = sorted((r.doc_id for r in docs.collect()), key=repr)
    assert 3 not in ids and 4 not in ids and 2 not in ids and None in ids and ids.count(1) == 1
    out = cp.pack_documents(spark, docs, SF_SMALL)
    assert out.count() >= docs.count()


def test_near_copies_with_null_and_repeated_ids(spark):
    """One document of each group stays, and no text without a copy is lost."""
    a, b, c, d, e = (" ".join(f"{w}{i}" for i in range(30)) for w in "abcde")
    rows = [(5, a), (9, a), (None, a), (None, a)]  # nulls go where an id is
    rows += [(None, b)] * 3 + [(None, b.upper())]  # only nulls: one row
    rows += [(9, c)]  # 9 copies 5, but this text is its own
    rows += [(7, d), (7, d.upper()), (8, d)]  # one id, two copies
    rows += [(6, e), (6, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text.lower()) for r in cp.drop_near_copies(spark, docs, SF_SMALL).collect()), key=repr)
    assert got == sorted([(5, a), (None, b), (9, c), (7, d), (6, e)], key=repr)


def test_columns_that_clash(spark):
    """Every stage hands on columns of any name and type as they are."""
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(120)
    names = ["_t", "score", "SCORE", "lang_pred", "_text", "evidence", "row", "_0", "fp", "doc_ID", "piece", "a.b", "bits", "smallest"]
    more = docs.select("*", *[F.concat(F.lit(f"{n}/"), F.col("doc_id").cast("string")).alias(n) for n in names],
                       F.create_map(F.lit("k"), F.col("doc_id")).alias("_h"))
    more = more.union(more.limit(15))  # repeated rows
    bare = docs.union(docs.limit(15))
    for _, stage in cp.STAGES[:3]:
        got = stage(spark, more, SF_SMALL)
        assert got.columns == more.columns
        rows = got.collect()
        for r in rows:
            told = dict(zip(got.columns, r))
            assert all(told[n] == f"{n}/{told['doc_id']}" for n in names) and told["_h"] == {"k": told["doc_id"]}
        kept = stage(spark, bare, SF_SMALL).collect()
        assert sorted(r[0] for r in rows) == sorted(r.doc_id for r in kept) and rows
    assert cp.pack_documents(spark, more, SF_SMALL).count() == cp.pack_documents(spark, bare, SF_SMALL).count()


@pytest.mark.parametrize("stage", [s for _, s in cp.STAGES])
def test_empty_table(spark, stage):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, empty, SF_SMALL).count() == 0


def test_folds_match_crc32(spark):
    import zlib

    df = spark.range(200).select("id", langid.is_held_out(F.col("id")).alias("a"), toxicity.is_held_out(F.col("id")).alias("b"))
    for r in df.collect():
        c = zlib.crc32(str(r.id).encode())
        assert (r.a, r.b) == (c % 4 == 2, c % 5 == 0)
