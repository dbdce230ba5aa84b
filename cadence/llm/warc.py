"""Merkle fixity audit of WARC files.

Pages become WARC records; a file holds about ``per_file`` of them, one after
the other. Every record is hashed. A file's tree has a node for each run of
``FAN_OUT`` consecutive children: it covers their offset range, and its hash
covers the range and the children's hashes in order. Replicas are compared
root by root; below a root that differs only the children of differing nodes
are looked at, level by level, down to the records.

DataFrame functions only. Bodies are read and hashed in the scan task and are
not shuffled; a node's children are at most ``FAN_OUT`` rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadence.llm.common import materialise

FAN_OUT = 16


def page_name(page_id: Column, url: Column) -> Column:
    """Hash that names a page: of its id and address (nulls: '')."""
    return F.md5(F.concat_ws("|", F.coalesce(page_id.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))


def record(page_id: Column, url: Column, body: Column) -> Column:
    """The bytes of a page's WARC resource record, as text."""
    text = F.coalesce(body, F.lit(""))
    name = page_name(page_id, url)
    uuid = F.concat_ws("-", *[F.substring(name, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nWARC-Record-ID: <urn:uuid:"), uuid,
        F.lit(">\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(text).cast("string"),
        F.lit("\r\n\r\n"), text, F.lit("\r\n\r\n"),
    )


def file_number(page_id: Column, url: Column, n_files: int) -> Column:
    """WARC file of a page, by its name, so that the pages of a repeated or
    null id are spread, and a page whose body was damaged stays in its file."""
    key = page_name(page_id, url)
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % F.lit(n_files).cast("long")


def records(pages: DataFrame, n_files: int, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(page_id, url, file, record): every page as a record of its file. Null
    url and body count as empty; repeated rows are records of their own."""
    i, u = F.col(id_col), F.col(url_col)
    return pages.select(
        i.alias("page_id"), u.alias("url"), file_number(i, u, n_files).alias("file"), record(i, u, F.col(body_col)).alias("record")
    )


def leaves(recs: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, idx, page_id, start, end, hash): the records of each file in
    order of page_id, url and hash, with their offset ranges. ``keys`` tells
    files apart, such as (rep, file) for several replicas in one table.

    A file's records are numbered in one task, as rows without bodies. Files
    hold about ``per_file`` pages unless one page, id and address alike, is in
    the table more often than that."""
    hashed = recs.select(
        *keys, "page_id", "url", F.octet_length("record").cast("long").alias("n"), F.sha2("record", 256).alias("hash")
    )
    w = Window.partitionBy(*keys).orderBy("page_id", "url", "hash")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0).cast("long"))
    return hashed.select(
        *keys, (F.row_number().over(w) - 1).cast("long").alias("idx"), "page_id", start.alias("start"),
        (start + F.col("n")).alias("end"), "hash",
    )


def tree(leaf: DataFrame, levels: int | None = None, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """(keys, level, idx, start, end, hash, page_id): level 0 are the records,
    level ``levels`` the roots. With no ``levels``, there are as many as bring
    the largest file to one root, three at least; with fewer than a file needs
    several nodes are left on the top level, which are all compared. Each level
    is written, as the next one and the comparison read it."""
    below = materialise(leaf)
    if levels is None:
        last = below.agg(F.max("idx").alias("i")).first()["i"]
        levels = max(3, levels_for((last or 0) + 1))
    made = [below.select(*keys, F.lit(0).alias("level"), "idx", "start", "end", "hash", "page_id")]
    none = F.lit(None).cast(leaf.schema["page_id"].dataType).alias("page_id")
    for level in range(1, levels + 1):
        kids = F.array_sort(F.collect_list(F.struct("idx", "start", "end", "hash")))
        rows = below.groupBy(*keys, F.floor(F.col("idx") / FAN_OUT).cast("long").alias("up")).agg(kids.alias("kids"))
        start, end = F.col("kids")[0]["start"], F.element_at("kids", -1)["end"]
        spell = F.concat_ws(
            "\n", F.concat_ws("-", start.cast("string"), end.cast("string")), F.transform("kids", lambda k: k["hash"])
        )
        below = materialise(rows.select(
            *keys, F.col("up").alias("idx"), start.alias("start"), end.alias("end"), F.sha2(spell, 256).alias("hash")
        ))
        made.append(below.select(*keys, F.lit(level).alias("level"), "idx", "start", "end", "hash", none))
    return reduce(DataFrame.unionByName, made)


def paired(nodes: DataFrame) -> DataFrame:
    """(file, level, idx, a, b): the nodes of both replicas (``rep`` 0 and 1)
    side by side, null where a replica has none."""
    node = F.struct("start", "end", "hash", "page_id")
    return nodes.groupBy("file", "level", "idx").agg(
        F.max(F.when(F.col("rep") == 0, node)).alias("a"), F.max(F.when(F.col("rep") == 1, node)).alias("b")
    )


def differing(pairs: DataFrame, levels: int) -> DataFrame:
    """The pairs of nodes that differ or are in one replica only, found from
    the roots down: below the roots only children of differing nodes are
    compared. ``pairs`` should be materialised, as each level reads its rows."""
    cols = pairs.columns
    found: list[DataFrame] = []
    for level in range(levels, -1, -1):
        other = ~F.col("a.hash").eqNullSafe(F.col("b.hash")) | ~F.col("a.start").eqNullSafe(F.col("b.start"))
        rows = pairs.where((F.col("level") == level) & other)
        if found:
            up = F.floor(F.col("idx") / FAN_OUT).cast("long")
            above = found[-1].select("file", F.col("idx").alias("up"))
            rows = rows.withColumn("up", up).join(above, ["file", "up"], "left_semi").select(*cols)
        found.append(materialise(rows))
    return reduce(DataFrame.unionByName, found)


def audit(pairs: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(files, damage) of two replicas' paired trees.

    ``damage``: (file, idx, page_id, start, end, kind) of the records that do
    not lie in both replicas alike. Kinds: ``changed`` (the page is there with
    other bytes), ``moved`` (its bytes lie at another offset, as after a lost
    record), ``missing`` (in the first replica only), ``extra`` (in the second
    only). Positions are those of the first replica, for ``extra`` of the
    second.

    ``files``: (file, n_records, n_bytes, root, replica_root, matches,
    branches_opened) for every file of either replica."""
    nodes = differing(pairs, levels)
    bad = nodes.where("level = 0")
    # a row per record and replica; the k-th of equal (page, hash) rows of one
    # replica meets the k-th of the other, then the k-th of a page's others
    side = F.inline(F.filter(F.array(
        F.struct(F.lit(0).alias("rep"), F.col("a").alias("n")), F.struct(F.lit(1).alias("rep"), F.col("b").alias("n"))
    ), lambda x: x["n"].isNotNull()))
    rows = bad.select("file", "idx", side).select("file", "idx", "rep", "n.*")
    k = F.row_number().over(Window.partitionBy("rep", "file", "page_id", "hash").orderBy("idx"))
    place = F.struct("idx", "start", "end")
    same = rows.withColumn("k", k).groupBy("file", "page_id", "hash", "k").agg(
        F.max(F.when(F.col("rep") == 0, place)).alias("a"), F.max(F.when(F.col("rep") == 1, place)).alias("b"))
    same = materialise(same)
    moved = same.where("a is not null and b is not null and a.start <> b.start").select(
        "file", "a.idx", "page_id", "a.start", "a.end", F.lit("moved").alias("kind"))
    lone = same.where("a is null or b is null").select(
        "file", "page_id", F.when(F.col("a").isNotNull(), 0).otherwise(1).alias("rep"), F.coalesce("a", "b").alias("at"))
    k = F.row_number().over(Window.partitionBy("rep", "file", "page_id").orderBy("at.idx"))
    fate = lone.withColumn("k", k).groupBy("file", "page_id", "k").agg(
        F.max(F.when(F.col("rep") == 0, F.col("at"))).alias("a"), F.max(F.when(F.col("rep") == 1, F.col("at"))).alias("b"))
    kind = F.when(F.col("a").isNull(), "extra").when(F.col("b").isNull(), "missing").otherwise("changed")
    fate = fate.select("file", "page_id", F.coalesce("a", "b").alias("at"), kind.alias("kind"))
    damage = moved.unionByName(fate.select("file", "at.idx", "page_id", "at.start", "at.end", "kind"))

    tops = F.col("level") == levels
    hashes = lambda c: F.concat_ws(",", F.transform(F.array_sort(F.collect_list(
        F.when(tops & F.col(c).isNotNull(), F.struct("idx", F.col(c)["hash"].alias("h"))))), lambda x: x["h"]))
    opened = nodes.where("level > 0").groupBy("file").agg(F.count(F.lit(1)).alias("m"))
    files = pairs.groupBy("file").agg(
        F.count(F.when((F.col("level") == 0) & F.col("a").isNotNull(), 1)).alias("n_records"),
        F.coalesce(F.max(F.when(F.col("level") == 0, F.col("a")["end"])), F.lit(0).cast("long")).alias("n_bytes"),
        F.nullif(hashes("a"), F.lit("")).alias("root"), F.nullif(hashes("b"), F.lit("")).alias("replica_root"),
    ).join(opened, "file", "left").select(
        "file", "n_records", "n_bytes", "root", "replica_root",
        F.col("root").eqNullSafe(F.col("replica_root")).alias("matches"),
        F.coalesce("m", F.lit(0).cast("long")).alias("branches_opened"),
    )
    return files, damage


def replicas(pages: DataFrame, replica: DataFrame, n_files: int, levels: int | None = None) -> DataFrame:
    """The paired trees of two tables of pages laid out in ``n_files`` files,
    materialised."""
    both = records(pages, n_files).withColumn("rep", F.lit(0)).unionByName(records(replica, n_files).withColumn("rep", F.lit(1)))
    keys = ("rep", "file")
    return materialise(paired(tree(leaves(both, keys), levels, keys)))


def levels_for(most_records: int) -> int:
    """Levels above the records that bring a file to one root."""
    n, levels = max(1, most_records), 1
    while FAN_OUT**levels < n:
        levels += 1
    return levels


def fixity_report(pages: DataFrame, replica: DataFrame, per_file: int = 256) -> DataFrame:
    """One row per WARC file: its size, both roots, whether they match, how
    many branches were opened, how many records are damaged of each kind, and
    ``damaged`` (the page ids, ascending, joined by commas; a null id: 'null').

    Both tables are laid out in the same number of files, from the first
    one's rows. Every file has one root (see ``tree``). Two empty tables: no
    rows."""
    n_files = max(1, -(-pages.count() // per_file))
    pairs = replicas(pages, replica, n_files)
    levels = pairs.agg(F.max("level").alias("l")).first()["l"]
    files, damage = audit(pairs, 3 if levels is None else levels)
    kinds = ("changed", "moved", "missing", "extra")
    told = damage.groupBy("file").agg(
        *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in kinds],
        F.concat_ws(",", F.transform(
            F.array_sort(F.collect_list(F.struct("page_id", "idx"))),
            lambda d: F.coalesce(d["page_id"].cast("string"), F.lit("null")),
        )).alias("damaged"),
    )
    zero = F.lit(0).cast("long")
    return files.join(told, "file", "left").select(
        *files.columns, *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in kinds], F.coalesce("damaged", F.lit("")).alias("damaged")
    )
