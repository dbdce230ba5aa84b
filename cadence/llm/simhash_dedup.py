"""SimHash near-duplicates by multi-index hashing.

A fingerprint counts, for each of 64 bits, the shingle hashes that have it
set; the bit is 1 when more than half do. Two fingerprints within ``radius``
bits must be within ``radius // segments`` bits in at least one of
``segments`` equal segments. So every fingerprint is stored under the exact
value of each segment, and every fingerprint probes each segment's table with
all values in the Hamming ball of that smaller radius; matches are verified on
the full distance. Equal fingerprints are merged before the search, so copies
never make pairs, and every verified pair of different fingerprints is kept.

Shuffles: one row of vote sums per document (partial sums are formed in the
scan task), the distinct fingerprints, the ball probes (66 for each distinct
fingerprint with two 32-bit segments), and the verified links.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import connected_components, materialise, unwrapped, wrapped
from cadence.llm.votes import hex16, majority, vote_sums

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Separators of words: space and U+0009 to U+000D.
SPACES = r"[\x20\x09-\x0D]+"


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, SPACES), lambda w: w != "")


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long), one row per input row.

    Words are lower-cased in A-Z only; shingles are ``shingle`` consecutive
    words joined by a space, repeats counted, hashed with XXH64 (seed 42).
    Fewer words: the whole sequence is one shingle. No words, empty or null
    text: fingerprint zero. Repeated rows stay (each gets its row).
    """
    return _by_text(docs, shingle, id_col, text_col).select(
        "doc_id", "fp", F.explode(F.expr("sequence(1, cast(_rows as int))")).alias("_i")
    ).drop("_i")


def _by_text(docs: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, _t, fp, _rows): a row per id and text hash."""
    src = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(F.col(text_col)).alias("_t"),
        _words(F.col(text_col)).alias("_w"),
    )
    n = F.size("_w")
    parts = [
        F.when(n >= shingle, F.slice("_w", i + 1, F.greatest(n - (shingle - 1), F.lit(0))))
        .otherwise(F.array(F.concat_ws(" ", "_w")) if i == 0 else F.array().cast("array<string>"))
        for i in range(shingle)
    ]
    names = [f"_s{i}" for i in range(shingle)]
    zipped = F.arrays_zip(*[p.alias(c) for p, c in zip(parts, names)])
    each = src.select("doc_id", "_t", (n > 0).alias("_any"), F.posexplode(zipped).alias("_p", "_z"))
    h = F.when(F.col("_any"), F.xxhash64(F.concat_ws(" ", *[F.col(f"_z.{i}") for i in names])))
    votes = each.groupBy("doc_id", "_t").agg(
        F.count(F.when(F.col("_p") == 0, 1)).alias("_rows"),
        F.count(h).alias("_n"),
        *vote_sums(h),
    )
    return votes.select("doc_id", "_t", majority("_n").alias("fp"), "_rows")


def _segments(bits: int, segments: int) -> list[tuple[int, int]]:
    """(shift, width) of each segment; widths differ by one bit at most."""
    width, more = divmod(bits, segments)
    out, at = [], 0
    for s in range(segments):
        w = width + (s < more)
        out.append((at, w))
        at += w
    return out


def _ball(width: int, radius: int) -> list[int]:
    """All masks of up to ``radius`` set bits among ``width`` bits."""
    return [sum(1 << b for b in c) for k in range(radius + 1) for c in combinations(range(width), k)]


def links(fps: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct ``fp`` values of ``fps`` that
    differ in at most ``radius`` bits. Each pair once; none is lost."""
    small = radius // segments
    seg = _segments(64, segments)
    value = [F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1).cast("long")) for at, w in seg]
    stored = fps.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("s"), v.alias("k")) for s, v in enumerate(value)])).alias("e"),
        F.col("fp").alias("b"),
    ).select("e.s", "e.k", "b")
    probes = fps.select(
        F.inline(F.array(*[
            F.struct(F.lit(s).alias("s"), v.alias("v"),
                     F.array(*[F.lit(m).cast("long") for m in _ball(w, small)]).alias("masks"))
            for s, ((_, w), v) in enumerate(zip(seg, value))
        ])),
        F.col("fp").alias("a"),
    ).select("s", F.explode("masks").alias("m"), "v", "a").select("s", F.col("v").bitwiseXOR(F.col("m")).alias("k"), "a")
    x = F.col("a").bitwiseXOR(F.col("b"))
    found = probes.join(stored, ["s", "k"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= radius))
    # a pair that matches in several segments counts in the first only
    first = F.lit(None).cast("int")
    for s in reversed(range(segments)):
        at, w = seg[s]
        part = F.shiftrightunsigned(x, at).bitwiseAND(F.lit((1 << w) - 1).cast("long"))
        first = F.when(F.bit_count(part) <= small, F.lit(s)).otherwise(first)
    return found.where(F.col("s") == first).select("a", "b")


def _smallest(fp: DataFrame, value: Column, radius: int, segments: int) -> DataFrame:
    """(fp, smallest): the smallest ``value`` of the rows in the component of
    each distinct fingerprint."""
    distinct = materialise(fp.groupBy("fp").agg(F.min(value).alias("rep")))
    pairs = links(distinct, radius, segments)
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = connected_components(edges).select(F.col("id").alias("fp"), F.col("component").alias("root"))
    labelled = distinct.join(comp, "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = labelled.groupBy("root").agg(F.min("rep").alias("smallest"))
    return labelled.join(smallest, "root").select("fp", "smallest")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, radius: int = 3, segments: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id, fp) for every row of ``docs``.

    ``component_id`` is the smallest doc_id reachable over links of at most
    ``radius`` differing bits, itself included. A null doc_id is no possible
    representative; a row whose fingerprint only null ids have keeps a null
    component. An empty table gives an empty result.
    """
    fp = materialise(fingerprints(docs, shingle, id_col, text_col))
    by_fp = _smallest(fp, F.col("doc_id"), radius, segments).withColumnRenamed("smallest", "component_id")
    return fp.join(by_fp, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", "fp")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3, segments: int = 2) -> DataFrame:
    """One row of each near-duplicate group of ``docs``; columns unchanged,
    whatever they are called. A document is an id with a text, so an id that
    carries several texts loses those that copy others and keeps the rest. The
    smallest id stays, of its texts the one with the smallest hash; of rows
    that repeat both, the first by their JSON text. A null id tells no
    documents apart: it stays only in groups without another id."""
    rows = wrapped(docs, "doc_id", "text")
    fp = materialise(_by_text(rows, shingle, "doc_id", "text").select("doc_id", "_t", "fp", "_rows"))
    first = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "_t")
    kept = _smallest(fp, first, radius, segments)
    same = F.col("doc_id").eqNullSafe(F.col("smallest.doc_id")) & (F.col("_t") == F.col("smallest._t"))
    told = materialise(fp.join(kept, "fp").select("doc_id", "_t", same.alias("stays"), (F.col("_rows") > 1).alias("again")))
    rows = rows.select("row", "doc_id", F.xxhash64("text").alias("_t"))
    key = lambda d: d.select(F.col("doc_id").alias("_id"), F.col("_t").alias("_h"))
    equal = rows["doc_id"].eqNullSafe(F.col("_id")) & (rows["_t"] == F.col("_h"))
    # what goes, and rows that are repeated, are few: the others stay in place
    single = rows.join(key(told.where("not stays or again")), equal, "left_anti")
    several = rows.join(key(told.where("stays and again")), equal, "left_semi")
    # repeats meet in partial minima, so no task gets all of them
    once = several.groupBy("doc_id", "_t").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return unwrapped(single.select("row").union(once.select("row")), docs)
