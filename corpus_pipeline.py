"""Corpus pipeline: toxicity, language identification, SimHash near-dedup,
best-fit packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage
before kept; ``run`` writes each stage's result as Parquet in the shared
folder and reads it again for the next. The first three return the columns of
``documents``, the last one the places of the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadence.llm import common, langid, queries, simhash_dedup, toxicity
from cadence.session import scratch_path

#: A document goes from this toxicity score on; it stays from this share of
#: the best language on.
MAX_TOXICITY, MIN_LANGUAGE = 0.5, 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below ``MAX_TOXICITY``. The model learns from the
    labels of ids that are not held out. Null and empty texts stay."""
    model = queries.toxicity_model(common.pick(docs, "doc_id", "text"), common.read(spark, sf_dir, "labels"))
    scored = toxicity.score(common.wrapped(docs, "text"), model, id_cols=("row",))
    return common.unwrapped(scored.where(F.col("score") < MAX_TOXICITY), docs)


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an identified language: those without any letter, and
    those whose best language has less than ``MIN_LANGUAGE`` of the decoding's
    weight, go. The model learns from the rows that are not held out; with no
    such row there is no language to reject by, and only texts without letters
    go."""
    model = queries.language_model(common.pick(docs, "doc_id", "text", "lang"))
    rows = common.wrapped(docs, "text")
    if not model.langs:
        return common.unwrapped(rows.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")), docs)
    out = langid.identify(rows, model, id_cols=("row",))
    return common.unwrapped(out.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_LANGUAGE)), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by fingerprints of 3-word shingles
    within 3 bits: the one with the smallest doc_id, in one row; see
    ``keep_one`` for null and repeated ids."""
    return simhash_dedup.keep_one(docs, shingle=3, radius=3)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens."""
    return queries.packed(common.pick(docs, "doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("simhash_near_dedup", drop_near_copies),
    ("best_fit_packing", pack_documents),
]

#: The models and tokenizer of the stages have no SQL form; tests compare
#: run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left of ``documents``."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
