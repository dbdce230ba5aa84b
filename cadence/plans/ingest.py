"""Flatten landed JSON payloads into typed tables."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cadence.functions.scalars import try_cast_uuid
from cadence.session import checkpoint_dir

LISTEN_SCHEMA = (
    "listened_at long, inserted_at long, recording_msid string, "
    "track_metadata struct<track_name:string, artist_name:string, release_name:string, "
    "additional_info:struct<duration_ms:string, tracknumber:string>, "
    "mbid_mapping:struct<recording_mbid:string, release_mbid:string, caa_release_mbid:string, "
    "artist_mbids:array<string>>>"
)


def _txt(c):
    return F.nullif(F.trim(c), F.lit(""))


def flatten_listens(raw: DataFrame) -> DataFrame:
    """Listen documents (JSON text) -> typed columns. The document is parsed
    once with an explicit schema; nested-field pruning keeps only what is
    selected."""
    d = F.from_json("json_data", LISTEN_SCHEMA)
    t = raw.select("listen_md5", "username", d.alias("d"))
    m = F.col("d.track_metadata")
    return t.select(
        "listen_md5",
        F.col("username").cast("string").alias("username"),
        F.timestamp_seconds(F.col("d.listened_at")).cast("timestamp_ntz").alias("listen_at_ts_utc"),
        try_cast_uuid(_txt(F.col("d.recording_msid"))).alias("recording_msid"),
        _txt(m["track_name"]).alias("track_name"),
        _txt(m["artist_name"]).alias("artist_name"),
        _txt(m["release_name"]).alias("release_name"),
        try_cast_uuid(_txt(m["mbid_mapping"]["release_mbid"])).alias("release_mbid"),
        try_cast_uuid(_txt(m["mbid_mapping"]["recording_mbid"])).alias("recording_mbid"),
        m["mbid_mapping"]["artist_mbids"].alias("artist_mbids"),
        try_cast_uuid(_txt(m["mbid_mapping"]["caa_release_mbid"])).alias("caa_release_mbid"),
        F.expr("try_cast(trim(d.track_metadata.additional_info.duration_ms) as int)").alias("duration_ms"),
        F.expr("try_cast(trim(d.track_metadata.additional_info.tracknumber) as int)").alias("tracknumber"),
        F.timestamp_seconds(F.col("d.inserted_at")).cast("timestamp_ntz").alias("_lb_insert_ts_utc"),
    )


DUMP_LINE_SCHEMA = (
    "user_id long, track_metadata struct<additional_info:struct<"
    "artist_mbids:array<string>, artist_mbid:string, lastfm_artist_mbid:string>>"
)


def scan_listen_dump(lines: DataFrame) -> DataFrame:
    """Lines of a listen dump (``value``: JSON, as ``spark.read.text`` gives
    them) -> one (user_id, artist_mbid) per valid id.
    A non-empty id list wins (even when none of its ids parse); otherwise a
    non-empty scalar id; ids parse leniently to canonical text."""
    from cadence.functions.scalars import try_uuid

    d = lines.select(F.from_json("value", DUMP_LINE_SCHEMA).alias("d")).select("d.*")
    info = F.col("track_metadata.additional_info")
    lst, one = info["artist_mbids"], info["artist_mbid"]
    ids = (
        F.when(F.size(lst) > 0, lst)
        .when(F.coalesce(one, F.lit("")) != "", F.array(one))
        .otherwise(F.array().cast("array<string>"))
    )
    parsed = F.filter(F.transform(ids, lambda x: try_uuid(x)), lambda x: x.isNotNull())
    return d.select("user_id", F.explode(parsed).alias("artist_mbid"))


def count_pairs(listens: DataFrame) -> DataFrame:
    """Multiplicity of (user, artist) rows -> listen_count."""
    return listens.groupBy("user_id", "artist_mbid").agg(F.count(F.lit(1)).alias("listen_count"))


OBJECT_SCHEMA = (
    "id string, `artist-credit` array<struct<artist:struct<id:string>>>, `release-group` struct<id:string>"
)
#: What a dump text is made of, as far as its objects' ends are concerned: a
#: string (closed or not: JSON strings hold no line break), a brace, a line
#: that begins with one.
JSON_PIECES = re.compile(r'"(?:[^"\\\n]|\\[^\n])*("?)|\n\{|[{}]')
LINE_OBJECT = re.compile(r"\n\{")
#: A string, closed or not, or a brace.
STRING_OR_BRACE = re.compile(r'"(?:[^"\\\n]|\\[^\n])*("?)|[{}]')
#: States at a cut: outside of strings, in one, in one after a backslash; each
#: with the text that leads there.
LEADS = ("", '"', '"\\')
#: Pieces from which a stretch without a sure line is split by states.
LONG_STRETCH = 3
#: Characters of one range of a dump file.
RANGE_CHARS = 1 << 20


def _begins(text: str, newline: int) -> bool | None:
    """Whether the brace after this line break can only begin an object of its
    own: inside an object a brace follows a colon, comma or bracket. None if
    nothing but white space is before it."""
    at = newline - 1
    while at >= 0 and text[at].isspace():
        at -= 1
    return None if at < 0 else text[at] not in ":,["


def _object_end(text: str, begin: int) -> tuple[int, bool]:
    """(end of the object that begins here, whether it closes)."""
    depth = 0
    for m in JSON_PIECES.finditer(text, begin):
        piece = m.group()
        if piece[0] == '"':
            if not m.group(1):
                line = text.find("\n{", m.end())
                return (line + 1 if line >= 0 else len(text)), False
        elif piece == "}":
            depth -= 1
            if depth == 0:
                return m.end(), True
        else:
            if piece != "{" and _begins(text, m.start()):
                return m.start() + 1, False
            depth += 1
    return len(text), False


def object_spans(text: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(objects, rest) of a text of JSON objects one after the other: where
    each outermost pair of braces begins and ends, and where there is anything
    else than white space. Braces in strings do not count, nor do quotes
    outside of objects. An object that does not close ends where the next line
    begins an object; it is one stretch of the rest."""
    objects, rest = [], []
    at = 0
    while at < len(text):
        begin = text.find("{", at)
        junk = len(text) if begin < 0 else begin
        if text[at:junk].strip():
            rest.append((at, junk))
        if begin < 0:
            break
        at, closed = _object_end(text, begin)
        if closed:
            objects.append((begin, at))
        else:
            line = text.find("\n{", begin, at)
            at = line + 1 if line >= 0 else at
            rest.append((begin, at))
    return objects, rest


def _anchors(text: str) -> tuple[int, int] | None:
    """First and last place where an object begins whatever came before the
    text, or None."""
    sure = [m.start() + 1 for m in LINE_OBJECT.finditer(text) if _begins(text, m.start())]
    return (sure[0], sure[-1]) if sure else None


def _walk(text: str, state: int) -> tuple[list[tuple[int, int]], int, int, int] | None:
    """(braces, state at the end, least depth after a closing brace, least
    depth of anything else than braces and white space) of a text that begins
    in ``state``; depths count from its begin. A brace is (place, +1 or -1); a
    closing one's place is behind it. None if a line break is in a string."""
    whole = LEADS[state] + text
    back = len(LEADS[state])
    braces: list[tuple[int, int]] = []
    depth = seen = 0
    low = solid = len(whole) + 1
    for m in STRING_OR_BRACE.finditer(whole):
        if depth < solid and whole[seen:m.start()].strip():
            solid = depth
        seen = m.end()
        kind = whole[m.start()]
        if kind == '"':
            if m.start() or not state:
                solid = min(solid, depth)
            if not m.group(1):
                if seen == len(whole):
                    return braces, 1, low, solid
                return (braces, 2, low, solid) if whole[seen:] == "\\" else None
        elif kind == "{":
            braces.append((m.start() - back, 1))
            depth += 1
        else:
            braces.append((m.end() - back, -1))
            depth -= 1
            low = min(low, depth)
    if depth < solid and whole[seen:].strip():
        solid = depth
    return braces, 0, low, solid


def _outline(text: str) -> list[int | None | str]:
    """What a stretch needs to know of a piece: for each state it may begin in
    (state at the end, change of depth, the two least depths), and how its
    ends look."""
    out: list[int | None | str] = []
    for state in range(len(LEADS)):
        got = _walk(text, state)
        out += [None] * 4 if got is None else [got[1], sum(d for _, d in got[0]), got[2], got[3]]
    solid = text.rstrip()
    line = 2 if re.match(r"\s*\n\{", text) else int(text.startswith("{"))
    return [*out, line, "" if not text else "n" if text.endswith("\n") else "x", solid[-1:]]


def _states(outlines: list[list]) -> list[tuple[int, int, int]] | None:
    """(state, depth, piece in which the object open there began) at the begin
    of each piece of a stretch; None unless the stretch is nothing but whole
    objects and white space."""
    state = depth = owner = 0
    end, before, found = "", "", []
    for at, o in enumerate(outlines):
        found.append((state, depth, owner))
        after, change, low, solid = o[4 * state:4 * state + 4]
        line, tail, last = o[-3:]
        opens = line == 2 or (line == 1 and end == "n")
        if after is None or depth + low < 0 or depth + solid <= 0 or (opens and depth and before not in (":", ",", "[")):
            return None
        if depth == 0 or depth + low == 0:
            owner = at
        state, depth = int(after), depth + int(change)
        end, before = tail or end, last or before
    return found if state == 0 and depth == 0 else None


def _cut(text: str, state: int, depth: int) -> tuple[str | None, list[str], str | None]:
    """(end of the object open at the begin, whole objects, begin of the object
    open at the end) of a piece of a sound stretch."""
    head, objects, begin = None, [], None if depth else -1
    for place, step in _walk(text, state)[0]:
        depth += step
        if step > 0 and depth == 1:
            begin = place
        elif step < 0 and depth == 0:
            if begin is None:
                head = text[:place]
            else:
                objects.append(text[begin:place])
    if not depth:
        return head, objects, None
    return (text, objects, None) if begin is None else (head, objects, text[begin:])


def _split(text: str) -> list[tuple[str | None, str | None]]:
    objects, rest = object_spans(text)
    return [(text[a:b], None) for a, b in objects] + [(None, text[a:b].strip()) for a, b in rest]


def split_concatenated_json(texts: DataFrame, text_col: str = "value") -> DataFrame:
    """Whole texts of concatenated JSON objects -> (other columns, obj, bad):
    one row per object, which may reach over lines, in ``obj``, and one per
    stretch that is no object, in ``bad``. Nothing is dropped; whether an
    object parses is for the reader to say."""
    import pandas as pd

    others = [c for c in texts.columns if c != text_col]
    schema = texts.select(*others).schema.add("obj", "string").add("bad", "string")

    def fn(batches):
        for pdf in batches:
            for *own, text in pdf[[*others, text_col]].itertuples(index=False, name=None):
                rows = [(*own, *r) for r in _split(text if isinstance(text, str) else "")]
                yield pd.DataFrame(rows, columns=[*others, "obj", "bad"], dtype=object)

    return texts.mapInPandas(fn, schema)


def split_json_ranges(ranges: DataFrame, file_cols: list[str], order_cols: list[str], text_col: str = "value") -> DataFrame:
    """``split_concatenated_json`` for files that come in ranges, cut anywhere:
    (file columns, obj, bad), the same rows as for the whole texts.

    A line that begins with a brace which can follow nothing inside an object
    (``_begins``) begins an object in every state of the text before it. So
    what lies between the first and the last such line of a range is split in
    the task that has the range. The ends of neighbouring ranges are put
    together, up to the next such line, and split as one text: usually one
    object. A longer stretch without any such line is split piece by piece
    (``_split_stretches``); it is one text only if it is damaged.
    """
    import pandas as pd

    kept = [*file_cols, *order_cols]
    schema = ranges.select(*kept).schema.add("kind", "integer").add("obj", "string").add("bad", "string").add("piece", "string")

    def fn(batches):
        for pdf in batches:
            rows = []
            for *own, text in pdf[[*kept, text_col]].itertuples(index=False, name=None):
                text = text if isinstance(text, str) else ""
                sure = _anchors(text)
                if sure is None:
                    rows.append((*own, 1, None, None, text))
                    continue
                first, last = sure
                rows += [(*own, 0, obj, bad, None) for obj, bad in _split(text[first:last])]
                rows += [(*own, 1, None, None, text[:first]), (*own, 2, None, None, text[last:])]
            yield pd.DataFrame(rows, columns=[*kept, "kind", "obj", "bad", "piece"], dtype=object)

    checkpoint_dir(ranges.sparkSession)
    parts = ranges.mapInPandas(fn, schema).checkpoint()
    edges = parts.where("kind > 0").drop("obj", "bad")
    # the last sure line of a range (kind 2) opens a seam; pieces up to the
    # next one belong to it. The numbering sees no text.
    w = Window.partitionBy(*file_cols).orderBy(*order_cols, "kind").rowsBetween(Window.unboundedPreceding, 0)
    numbered = edges.select(*kept, "kind").withColumn("seam", F.sum((F.col("kind") == 2).cast("long")).over(w))
    numbered = numbered.select(*[F.col(c).alias(f"_{c}") for c in [*kept, "kind"]], "seam")
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*kept, "kind"]])
    pieces = F.sort_array(F.collect_list(F.struct(*order_cols, "kind", "piece")))
    seams = edges.join(numbered, same).select(*kept, "kind", "piece", "seam")
    short, sound = _split_stretches(seams, file_cols, order_cols)
    texts = short.groupBy(*file_cols, "seam").agg(
        F.array_join(F.transform(pieces, lambda p: p["piece"]), "").alias(text_col)).drop("seam")
    whole = parts.where("kind = 0").select(*file_cols, "obj", "bad")
    return whole.unionByName(sound).unionByName(split_concatenated_json(texts, text_col))


def _split_stretches(seams: DataFrame, file_cols: list[str], order_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """(pieces to put together, rows (file columns, obj, bad)): the stretches
    of ``LONG_STRETCH`` pieces or more, such as files of one line or indented
    throughout, split piece by piece.

    A task outlines its piece for each state in which it may begin. The
    outlines of a stretch, a few numbers a piece, are put one after the other;
    that gives the state and depth at each begin, and each piece is then split
    where it is. Only the fragments of an object that lies in several pieces
    meet, by that object. A stretch with any damage stays one text."""
    import pandas as pd

    keys = [*file_cols, "seam"]
    place = [*order_cols, "kind"]
    checkpoint_dir(seams.sparkSession)
    # counted without the texts
    many = seams.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LONG_STRETCH)
    named = lambda df, cols: df.select(*[F.col(c).alias(f"_{c}") for c in cols], *[c for c in df.columns if c not in cols])
    alike = lambda cols: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols])
    seams = seams.checkpoint()
    many = many.select(*keys).checkpoint()
    long = seams.join(named(many, keys), alike(keys), "left_semi")
    names = [f"o{i}" for i in range(4 * len(LEADS) + 1)] + ["tail", "last"]
    shape = seams.select(*keys, *place).schema
    told = seams.select(*keys, *place).schema
    for name in names:
        told = told.add(name, "string" if name in ("tail", "last") else "long")

    def outline(batches):
        for pdf in batches:
            rows = [(*own, *_outline(piece)) for *own, piece in pdf.itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[*keys, *place, *names], dtype=object)

    for name in ("state", "depth", "owner", "n"):
        shape = shape.add(name, "long")

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(place, ignore_index=True)
        rows = [[None if x is None or x != x else x for x in r] for r in pdf[names].itertuples(index=False, name=None)]
        found = _states(rows)
        if found is None:
            return pdf[[*keys, *place]].head(0).assign(state=0, depth=0, owner=0, n=0)
        state, depth, owner = zip(*found)
        return pdf[[*keys, *place]].assign(state=state, depth=depth, owner=owner, n=range(len(found)))

    begins = long.select(*keys, *place, "piece").mapInPandas(outline, told).groupBy(*keys).applyInPandas(states, shape).checkpoint()
    own = [*keys, *place]
    there = named(begins, own)
    cut_schema = seams.select(*keys).schema.add("owner", "long").add("n", "long").add("obj", "string").add("fragment", "string")

    def cut(batches):
        for pdf in batches:
            rows = []
            for *own_keys, piece, state, depth, owner, n in pdf.itertuples(index=False, name=None):
                head, objects, tail = _cut(piece, int(state), int(depth))
                rows += [(*own_keys, None, None, obj, None) for obj in objects]
                rows += [(*own_keys, owner, n, None, head)] if head is not None else []
                rows += [(*own_keys, n, n, None, tail)] if tail is not None else []
            yield pd.DataFrame(rows, columns=[*keys, "owner", "n", "obj", "fragment"], dtype=object)

    split = seams.join(there, alike(own)).select(*keys, "piece", "state", "depth", "owner", "n").mapInPandas(cut, cut_schema).checkpoint()
    parts = F.sort_array(F.collect_list(F.struct("n", "fragment")))
    joined = split.where("fragment is not null").groupBy(*keys, "owner").agg(
        F.array_join(F.transform(parts, lambda p: p["fragment"]), "").alias("obj"))
    none = F.lit(None).cast("string").alias("bad")
    rows = split.where("obj is not null").select(*file_cols, "obj", none).unionByName(joined.select(*file_cols, "obj", none))
    sound = begins.select(*keys).distinct()
    return seams.join(named(sound, keys), alike(keys), "left_anti"), rows


def read_dump_ranges(spark, path: str, chars: int = RANGE_CHARS) -> DataFrame:
    """(slug, file, block, line, value): the dump files below ``path`` in
    ranges of about ``chars`` characters, read in Spark's own splits, so that
    one file is many tasks; the slug is from the folder name
    ``slug=<packet>-<entity>``."""
    import pandas as pd

    lines = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"slug=([^/]+)", 1).alias("slug"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"), "value")

    columns = list(lines.columns)

    def fn(batches):
        held, size, key = [], 0, None
        for pdf in batches:
            out = []
            for slug, file, block, line, value in pdf.itertuples(index=False, name=None):
                if held and (key[:3] != (slug, file, block) or size >= chars):
                    out.append((*key, "".join(held)))
                    held, size = [], 0
                if not held:
                    key = (slug, file, block, line)
                held.append(value + "\n")
                size += len(value) + 1
            if out:
                yield pd.DataFrame(out, columns=columns)
        if held:
            yield pd.DataFrame([(*key, "".join(held))], columns=columns)

    return lines.mapInPandas(fn, lines.schema)


def scan_entity_dump(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dump files (slug, value), or their ranges (slug, file, block, line,
    value), -> (records, quarantine).

    records: (slug, packet_number, entity, mbid, containers) of the objects
    that carry an id. The slug is ``<packet>-<entity>``; containers are the
    release group and credited artists of releases, the credited artists of
    release groups. quarantine: (slug, bad), what is no object or does not
    parse; an object without an id is neither."""
    if "block" in files.columns:
        objs = split_json_ranges(files, ["slug", "file"], ["block", "line"])
    else:
        objs = split_concatenated_json(files)
    packet = F.regexp_extract("slug", r"^(\d+)-", 1).cast("long")
    ent = F.regexp_extract("slug", r"^\d+-(.+)$", 1)
    parses = F.expr("try_parse_json(obj)").isNotNull()
    quarantine = objs.where(F.col("bad").isNotNull() | ~parses).select("slug", F.coalesce("bad", "obj").alias("bad"))
    d = objs.where(F.col("obj").isNotNull() & parses & F.get_json_object("obj", "$.id").isNotNull()).select(
        "slug", packet.alias("packet_number"), ent.alias("entity"), F.from_json("obj", OBJECT_SCHEMA).alias("o"))
    artists = F.transform(F.coalesce(F.col("o.`artist-credit`"), F.array()),
                          lambda c: F.struct(c["artist"]["id"].alias("mbid"), F.lit("artist").alias("entity")))
    group = F.array(F.struct(F.col("o.`release-group`.id").alias("mbid"), F.lit("release-group").alias("entity")))
    containers = (
        F.when(F.col("entity") == "release-group", artists)
        .when(F.col("entity") == "release", F.concat(group, artists))
        .otherwise(F.array().cast("array<struct<mbid:string,entity:string>>"))
    )
    records = d.select("slug", "packet_number", "entity", F.col("o.id").alias("mbid"), containers.alias("containers"))
    return records, quarantine


def flatten_artist_stats(raw: DataFrame) -> DataFrame:
    """Successful artist-stats results -> typed rows; listeners stay JSON."""
    from cadence.functions.scalars import json_get, json_sub

    p = F.col("payload_json")
    ts = lambda path: F.timestamp_seconds(json_get(p, path).cast("long")).cast("timestamp_ntz")
    return raw.where(json_get(p, "$.success").cast("boolean")).select(
        F.col("mbid").alias("artist_mbid"),
        json_get(p, "$.data.stats_range").alias("stats_range"),
        json_get(p, "$.data.artist_name").alias("artist_name"),
        ts("$.data.from_ts").alias("from_ts"), ts("$.data.to_ts").alias("to_ts"),
        ts("$.data.last_updated").alias("last_updated"),
        json_get(p, "$.data.total_user_count").cast("int").alias("total_user_count"),
        json_get(p, "$.data.total_listen_count").cast("int").alias("total_listen_count"),
        json_sub(p, "$.data.listeners").alias("listeners"),
        F.col("ts_utc").alias("_insert_ts_utc"),
    )


FEEDBACK_SCHEMA = "feedback array<struct<user_id:string, recording_mbid:string, score:int, created:long, track_metadata:string>>"


def scan_feedback_pages(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feedback API pages (``value``: JSON) -> (feedback, quarantine).

    feedback: one row per (user, score, recording), the md5 of which is its
    key; delivered again, the latest counts. ``track_metadata`` stays JSON.
    quarantine: the entries without a valid recording id."""
    from cadence.functions.scalars import md5_join

    rows = texts.select(F.from_json("value", FEEDBACK_SCHEMA).alias("p")).select(F.explode("p.feedback").alias("f"))
    typed = rows.select(
        F.col("f.user_id").alias("username"), F.col("f.score").alias("score"), try_cast_uuid(F.col("f.recording_mbid")).alias("recording_mbid"),
        F.timestamp_seconds(F.col("f.created")).cast("timestamp_ntz").alias("feedback_at"),
        F.coalesce(F.col("f.track_metadata"), F.lit("{}")).alias("track_metadata"), F.to_json("f").alias("bad"))
    good = typed.where(F.col("recording_mbid").isNotNull()).withColumn("feedback_md5", md5_join("username", "score", "recording_mbid"))
    latest = good.groupBy("feedback_md5", "username", "score", "recording_mbid").agg(
        F.max(F.struct("feedback_at", "track_metadata")).alias("m"))
    return latest.select("feedback_md5", "username", "score", "recording_mbid", "m.*"), typed.where(F.col("recording_mbid").isNull()).select("bad")


def dump_file_info(files: DataFrame) -> DataFrame:
    """(slug, packet_number, entity, dump_timestamp) of dump files from their
    slug ``<packet>-<entity>`` and the text of the timestamp file beside them
    (``2025-12-04 23:31:59.823155+00``, UTC). No or no valid text: no time."""
    text = F.regexp_extract(F.coalesce("timestamp", F.lit("")), r"^\s*(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d(?:\.\d{1,6})?)", 1)
    return files.select(
        "slug", F.regexp_extract("slug", r"^(\d+)-", 1).cast("long").alias("packet_number"),
        F.regexp_extract("slug", r"^\d+-(.+)$", 1).alias("entity"), text.try_cast("timestamp_ntz").alias("dump_timestamp"))


PAGE_SCHEMA = ("payload struct<count:int, user_id:string, latest_listen_ts:long, listens:array<struct<"
               "listened_at:long, recording_msid:string, track_metadata:struct<track_name:string, artist_name:string>>>>")


def scan_listen_pages(texts: DataFrame) -> DataFrame:
    """Listen API pages (``value``: JSON) -> one row per listen, keyed by the md5 of the JSON
    list [user, recording_msid, listened_at] (immutable fields)."""
    from cadence.functions.scalars import json_list_hash

    pages = texts.select(F.from_json("value", PAGE_SCHEMA).alias("p")).select("p.*")
    rows = pages.select(F.col("payload.user_id").alias("username"), F.explode("payload.listens").alias("l"))
    return rows.select(
        json_list_hash(F.col("username"), F.col("l.recording_msid"), (F.col("l.listened_at"), "num")).alias("listen_md5"),
        "username",
        F.timestamp_seconds(F.col("l.listened_at")).cast("timestamp_ntz").alias("listen_at_ts_utc"),
        F.col("l.recording_msid").alias("recording_msid"),
        F.col("l.track_metadata.track_name").alias("track_name"),
    )
