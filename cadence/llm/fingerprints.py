"""Document fingerprints: weighted SimHash with permuted block tables.

Terms are pairs of neighbouring words (one word: the word). A term's weight is
its number of characters: in natural text long words are the rare ones, so
this follows information content without a pass over the corpus, and a
document's fingerprint depends on its own text alone. Each term occurrence
votes with its weight for or against each bit by the term's 64-bit hash.

``near_pairs`` finds all fingerprints within a Hamming radius: the 64 bits are
cut into ``blocks`` blocks; two fingerprints at most ``radius`` bits apart
agree on at least ``blocks - radius`` whole blocks. There is one table for
each choice of that many blocks, keyed by the permuted (gathered) block bits.

DataFrame functions only, no Python on the executors.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import materialise
from cadence.llm.votes import hex16, majority, vote_sums
from cadence.session import scratch_path

#: Rows of a block of the id order, as a power of two.
BLOCK_BITS = 6
#: First characters of a text that tell rows of one id apart in the order.
PREFIX = 32
LOWEST = -(1 << 63)
#: A fingerprint with more than this share of all rows is looked up by
#: broadcast: there are fewer than ``HOT_SHARE`` of them.
HOT_SHARE = 1024


def next_in_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, next_id, next_text): each row with the row after it by
    descending id; the last is followed by the first. Rows of one id come by
    the first ``PREFIX`` characters of the text, then by its hash; null ids
    come last, null texts count as empty. A one-row table is followed by
    itself.

    The rows are range-partitioned by that order and written with their
    positions; equal rows may be split too, so an id with any share of the
    rows is many tasks. Blocks of 64 positions are then the tasks' groups: the
    first row of a block is also sent to the block before as its end mark, and
    the first row of a partition to the last block of the partition before
    (one number per partition). No group grows with the table.
    """
    src = docs.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST).cast("long")).alias("_k"),
    ).select(
        "*", F.substring("text", 1, PREFIX).alias("_p"), F.xxhash64("text").alias("_x"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.desc("_k"), F.asc("_p"), F.asc("_x"), F.asc("_row")]
    path = scratch_path(docs.sparkSession, "order")
    src.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "doc_id", "text", F.monotonically_increasing_id().alias("_pos")
    ).write.option("compression", "zstd").parquet(path)
    placed = docs.sparkSession.read.parquet(path)
    part = F.shiftright("_pos", 33)
    ends = placed.groupBy(part.alias("_part")).agg(F.max("_pos").alias("last"))
    line = Window.partitionBy(F.lit(0)).orderBy("_part")
    whole = Window.partitionBy(F.lit(0))
    ends = ends.select("_part", F.coalesce(F.lag("last").over(line), F.max_by("last", "_part").over(whole)).alias("_end"))
    own = F.struct(F.shiftright("_pos", BLOCK_BITS).alias("b"), F.lit(0).alias("mark"))
    row = F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.when(row == 0, F.col("_end")).otherwise(F.col("_pos") - 1)
    mark = F.struct(F.shiftright(before, BLOCK_BITS).alias("b"), F.lit(1).alias("mark"))
    first = F.col("_pos").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) == 0
    dealt = placed.withColumn("_part", part).join(F.broadcast(ends), "_part").select(
        "doc_id", "text", "_pos", F.explode(F.when(first, F.array(own, mark)).otherwise(F.array(own))).alias("_e")
    ).select("doc_id", "text", "_pos", F.col("_e.b").alias("_b"), F.col("_e.mark").alias("_mark"))
    w = Window.partitionBy("_b").orderBy("_mark", "_pos")
    return dealt.select(
        "doc_id", "text", "_mark", F.lead("doc_id").over(w).alias("next_id"), F.lead("text").over(w).alias("next_text")
    ).where("_mark = 0").drop("_mark")


def word_list(text: Column) -> Column:
    """Lower-cased words between white space."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def terms(words: Column) -> Column:
    """array<struct<a, b>> of neighbouring words (one word: b is null; no
    words: one struct of nulls, so that the row is not lost). ``words`` should
    be a column of a projection of its own: it is used several times here."""
    n = F.size(words)
    none = F.array(F.lit(None).cast("string"))
    a = F.when(n > 1, F.slice(words, 1, n - 1)).when(n == 1, words).otherwise(none)
    b = F.when(n > 1, F.slice(words, 2, n - 1)).otherwise(none)
    return F.arrays_zip(a.alias("a"), b.alias("b"))


def fingerprint_texts(rows: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, rows long, fp long): one row for each different key; the keys
    must fix the text. ``rows``: how many input rows had the key. The partial
    sums are formed where the text is, so a row of sums per key is shuffled."""
    lists = rows.select(*keys, word_list(F.col(text_col)).alias("_words"))
    each = lists.select(*keys, F.posexplode(terms(F.col("_words"))).alias("_p", "_t"))
    h = F.when(F.col("_t.a").isNotNull(), F.xxhash64("_t.a", "_t.b"))
    weight = (F.length("_t.a") + F.coalesce(F.length("_t.b"), F.lit(0))).cast("long")
    return (
        each.groupBy(*keys)
        .agg(F.count(F.when(F.col("_p") == 0, 1)).alias("rows"), F.sum(weight).alias("_w"), *vote_sums(h, weight))
        .select(*keys, "rows", majority("_w").alias("fp"))
    )


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near_pairs(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct values of column ``fp`` within
    ``radius`` bits: all of them, each once (from the first table that holds
    the pair)."""
    if not 0 <= radius < blocks <= 64:
        raise ValueError("needs 0 <= radius < blocks <= 64")
    edges = [round(i * 64 / blocks) for i in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    mask = [F.expr(f"cast('{m}' as bigint)") for m in signed]
    table = fps.select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(m).alias("k")) for t, m in enumerate(mask)])).alias("e"),
        "fp",
    ).select("e.t", "e.k", "fp")
    left, right = table.withColumnRenamed("fp", "a"), table.withColumnRenamed("fp", "b")
    x = F.col("a").bitwiseXOR(F.col("b"))
    first = F.coalesce(*[F.when(x.bitwiseAND(m) == 0, F.lit(t)) for t, m in enumerate(mask)])
    return (
        left.join(right, ["t", "k"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(x) <= radius) & (F.col("t") == first))
        .select("a", "b")
    )


def near_counts(fps: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, n_near): for each distinct fingerprint the number of other rows of
    ``fps`` within ``radius`` bits, equal ones included."""
    distinct = fps.groupBy("fp").agg(F.sum("rows").alias("n"))
    pairs = near_pairs(distinct, radius, blocks)
    both = pairs.union(pairs.select("b", "a")).toDF("fp", "other")
    others = both.join(distinct.select(F.col("fp").alias("other"), "n"), "other").groupBy("fp").agg(F.sum("n").alias("m"))
    return distinct.join(others, "fp", "left").select(
        "fp", (F.col("n") - 1 + F.coalesce("m", F.lit(0).cast("long"))).alias("n_near")
    )


def hot_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp): those with more than one ``HOT_SHARE``-th of the rows of ``fps``."""
    many = fps.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    least = -(-fps.count() // HOT_SHARE)
    return many.where(F.col("n") > least).select("fp")


def document_fingerprints(docs: DataFrame, radius: int = 3, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: fingerprint of the text and of its edited
    text (its last third replaced by the start of the next document, by
    descending id), their likenesses and the number of near documents.

    Null text counts as empty (fingerprint zero); repeated rows stay; an empty
    table gives no rows; other columns are ignored.
    """
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - cut), F.col("next_text").substr(F.lit(1), cut))
    rows = next_in_order(docs, id_col, text_col).select(
        "doc_id", F.xxhash64("text").alias("h"), n.cast("long").alias("n_chars"), "next_id",
        F.xxhash64("next_text").alias("next_h"), "text", edited.alias("edited"),
    )
    keys = ["doc_id", "h", "n_chars", "next_id", "next_h", "edited_sha", "edit"]
    both = rows.select(
        *keys[:5], F.unhex(F.sha2(F.col("edited"), 256)).alias("edited_sha"),
        F.inline(F.array(
            F.struct(F.lit(False).alias("edit"), F.col("text").alias("body")),
            F.struct(F.lit(True).alias("edit"), F.col("edited").alias("body")),
        )),
    )
    fps = fingerprint_texts(both, keys, "body")
    one = materialise(fps.groupBy(*keys[:6]).agg(
        F.max("rows").alias("rows"),
        F.max(F.when(~F.col("edit"), F.col("fp"))).alias("fp"),
        F.max(F.when(F.col("edit"), F.col("fp"))).alias("edited_fp"),
    ))
    following = one.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.max("fp").alias("next_fp"))
    near = materialise(near_counts(one, radius, blocks))
    rows = one.join(
        following, one["next_id"].eqNullSafe(following["_id"]) & (one["next_h"] == following["_h"]), "left"
    )
    hot = F.broadcast(hot_fingerprints(one))
    # rows of a frequent fingerprint would all meet in one task of the join
    counted = rows.join(hot, "fp", "left_anti").join(near, "fp").unionByName(
        rows.join(F.broadcast(near.join(hot, "fp", "left_semi")), "fp")
    )
    return (
        counted.select(
            "doc_id", "n_chars", F.lower(F.hex("edited_sha")).alias("edited_sha256"),
            hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("edited_fp")).alias("edited_fingerprint"),
            likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
            likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
            "n_near", F.explode(F.expr("sequence(1, cast(rows as int))")).alias("_i"),
        )
        .drop("_i")
    )
