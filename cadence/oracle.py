"""Independent SQL (DuckDB dialect) for every registered query.

The views ``events``, ``embeddings``, ``part``, ``nation``, ``orders``,
``lineitem`` ... are registered by the checker. ``ADAPTERS`` restate the
derivations of ``cadence.sources.testdata`` in SQL; each query body is
prefixed with the CTEs it needs (in dependency order).
"""

from __future__ import annotations


def mbid(kind: str, expr: str) -> str:
    return (
        "regexp_replace(md5('" + kind + "' || CAST((" + expr + ") AS VARCHAR)), "
        "'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
    )


K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

LISTEN_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
DUMP_AS_OF = "TIMESTAMP '2001-08-01 00:00:00'"

ADAPTERS: dict[str, str] = {}

ADAPTERS["listens"] = f"""
SELECT md5(CAST(event_id AS VARCHAR)) AS listen_md5,
       'u' || CAST(user_id % 10 AS VARCHAR) AS username,
       {mbid('r', K + ' % 12')} AS recording_mbid,
       {mbid('l', K + ' % 25')} AS release_mbid,
       [{mbid('a', K + ' % 12')}, {mbid('a', K + ' % 7')}] AS artist_mbids,
       ts AS listen_at_ts_utc,
       CAST(round(value * 1000) AS BIGINT) AS duration_ms,
       'Track ' || CAST({K} % 12 AS VARCHAR) AS track_name,
       'Release ' || CAST({K} % 25 AS VARCHAR) AS release_name,
       'Artist ' || CAST({K} % 12 AS VARCHAR) AS artist_name,
       event_type
FROM events"""

ADAPTERS["feedback"] = """
SELECT username, recording_mbid, 1 AS score, listen_at_ts_utc AS feedback_at
FROM listens WHERE event_type = 'purchase'"""

ADAPTERS["releases"] = f"""
SELECT DISTINCT {mbid('l', 'p_partkey % 25')} AS release_mbid,
       {mbid('g', 'p_partkey % 25 % 12')} AS release_group_mbid,
       'Release ' || CAST(p_partkey % 25 AS VARCHAR) AS release_title,
       'Artist ' || CAST(p_partkey % 25 % 12 AS VARCHAR) AS artist_credit_phrase
FROM part"""

ADAPTERS["release_groups"] = f"""
SELECT DISTINCT {mbid('g', 'p_partkey % 12')} AS release_group_mbid,
       'Album ' || CAST(p_partkey % 12 AS VARCHAR) AS release_group_title,
       'Artist ' || CAST(p_partkey % 12 % 12 AS VARCHAR) AS artist_credit_phrase,
       CAST(1990 + p_partkey % 12 AS INTEGER) AS release_group_year
FROM part"""

ADAPTERS["recordings"] = f"""
SELECT DISTINCT {mbid('r', 'p_partkey % 10')} AS recording_mbid,
       'Track ' || CAST(p_partkey % 10 AS VARCHAR) AS recording_title,
       'Artist ' || CAST(p_partkey % 10 % 12 AS VARCHAR) AS artist_credit_phrase
FROM part"""

ADAPTERS["artist_ann"] = f"""
SELECT {mbid('a', 'p_partkey % 11')} AS artist_mbid,
       'Artist ' || CAST(p_partkey % 11 AS VARCHAR) AS artist_name,
       lower(p_type) AS tag,
       CASE WHEN p_size > 45 THEN NULL ELSE 1990 + p_size % 25 END AS year
FROM part"""

ADAPTERS["artists"] = """
SELECT b.artist_mbid, b.artist_name, t.tags_string,
       CAST(b.y0 AS VARCHAR) || '-' || CAST(b.y1 AS VARCHAR) AS active_years
FROM (SELECT artist_mbid, max(artist_name) AS artist_name, min(year) AS y0, max(year) AS y1
      FROM artist_ann GROUP BY 1) b
LEFT JOIN (SELECT artist_mbid, string_agg(tag, ', ' ORDER BY c DESC, tag) AS tags_string
           FROM (SELECT artist_mbid, tag, count(*) AS c FROM artist_ann GROUP BY 1, 2) GROUP BY 1) t
USING (artist_mbid)"""

ADAPTERS["files"] = f"""
SELECT 'lib/' || CAST(label AS VARCHAR) || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.flac' AS filepath,
       CAST(embedding AS DOUBLE[]) AS embedding,
       vec_id % 37 <> 0 AS embedding_success,
       CAST(least(30 + vec_id % 300, 90) AS INTEGER) AS embedding_duration_seconds,
       CAST(30 + vec_id % 300 AS DOUBLE) + 0.5 AS track_length_seconds,
       {mbid('r', 'vec_id % 10')} AS recording_mbid,
       {mbid('l', 'vec_id % 25')} AS release_mbid,
       {mbid('g', 'vec_id % 25 % 8')} AS release_group_mbid,
       {mbid('a', 'label')} AS artist_mbid,
       CASE WHEN vec_id % 4 <> 0 THEN {mbid('a', 'vec_id % 13')} END AS album_artist_mbid,
       'Track ' || CAST(vec_id % 10 AS VARCHAR) AS track_name,
       'Album ' || CAST(vec_id % 25 % 8 AS VARCHAR) AS album_name,
       'Artist ' || CAST(label AS VARCHAR) AS artist_name,
       CASE WHEN vec_id % 4 <> 0 THEN 'Artist ' || CAST(vec_id % 13 AS VARCHAR) END AS album_artist_name,
       md5('Track ' || CAST(vec_id % 10 AS VARCHAR) || '-Album ' || CAST(vec_id % 25 % 8 AS VARCHAR)
           || '-Artist ' || CAST(label AS VARCHAR)) AS recording_md5,
       label, vec_id
FROM embeddings"""

ADAPTERS["cf_scores"] = f"""
SELECT least({mbid('a', 'a.n_nationkey')}, {mbid('a', 'b.n_nationkey')}) AS artist_mbid_a,
       greatest({mbid('a', 'a.n_nationkey')}, {mbid('a', 'b.n_nationkey')}) AS artist_mbid_b,
       CASE WHEN a.n_nationkey = b.n_nationkey THEN 1.0
            ELSE CAST((a.n_nationkey * b.n_nationkey) % 7 AS DOUBLE) / 7.0 END AS score_value
FROM nation a JOIN nation b ON a.n_nationkey <= b.n_nationkey"""

ADAPTERS["cf_sym"] = """
SELECT artist_mbid_a, artist_mbid_b, score_value FROM cf_scores
UNION ALL
SELECT artist_mbid_b, artist_mbid_a, score_value FROM cf_scores WHERE artist_mbid_a <> artist_mbid_b"""

ADAPTERS["playlist_seeds"] = """
SELECT 'p' || CAST(label AS VARCHAR) AS playlist_id,
       'u' || CAST(label % 10 AS VARCHAR) AS username,
       filepath, CAST(seed_rank AS DOUBLE) AS weight
FROM (SELECT filepath, label,
             row_number() OVER (PARTITION BY label ORDER BY md5(filepath), filepath) AS seed_rank
      FROM files)
WHERE seed_rank <= 3"""

ADAPTERS["dump_records"] = f"""
SELECT strftime(o_orderdate, '%Y%m%d') AS slug,
       CAST(o_orderdate AS DATE) AS dump_date,
       o_custkey AS user_id,
       {mbid('s', 'l_suppkey')} AS artist_mbid,
       CAST(l_quantity AS BIGINT) AS listen_count
FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""

ADAPTERS["name_map"] = f"""
SELECT md5('Track ' || CAST(n % 10 AS VARCHAR) || '-Album ' || CAST(n % 8 AS VARCHAR) || '-Artist ' || CAST(n % 10 AS VARCHAR)) AS recording_md5,
       'Track ' || CAST(n % 10 AS VARCHAR) AS recording_name,
       'Album ' || CAST(n % 8 AS VARCHAR) AS release_name,
       'Artist ' || CAST(n % 10 AS VARCHAR) AS artist_name,
       [{mbid('a', 'n % 10')}, {mbid('a', '(n + 1) % 10')}] AS artist_mbids,
       CASE WHEN n % 11 = 0 THEN NULL ELSE {mbid('r', '(n + 3) % 10')} END AS recording_mbid,
       {mbid('l', 'n % 25')} AS release_mbid,
       {mbid('g', 'n % 8')} AS release_group_mbid,
       'Album ' || CAST(n % 8 AS VARCHAR) AS mapped_release_name,
       'Track ' || CAST(n % 10 AS VARCHAR) AS mapped_recording_name,
       'Artist ' || CAST(n % 10 AS VARCHAR) AS mapped_artist_name
FROM (SELECT DISTINCT p_partkey % 40 AS n FROM part)
WHERE n % 7 <> 0"""

ADAPTERS["map_file_recording"] = """
SELECT f.filepath, m.recording_mbid FROM files f JOIN name_map m USING (recording_md5) WHERE m.recording_mbid IS NOT NULL
UNION
SELECT filepath, recording_mbid FROM files WHERE recording_mbid IS NOT NULL"""

DEPS = {
    "artists": ["artist_ann"],
    "map_file_recording": ["files", "name_map"],
    "feedback": ["listens"],
    "cf_sym": ["cf_scores"],
    "playlist_seeds": ["files"],
}


def with_views(names: list[str], body: str) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    if not order:
        b = body.lstrip()
        if b.startswith(","):
            return "WITH " + b[1:].lstrip()
        return body
    ctes = ",\n".join(f"{n} AS ({ADAPTERS[n]})" for n in order)
    if body.lstrip().startswith(","):
        return f"WITH {ctes}\n{body}"
    return f"WITH {ctes}\n{body}"


def q(names: list[str], body: str) -> str:
    """Adapters as CTEs, then ``body`` (which may continue the WITH list
    with ', name AS (...)' before its final SELECT)."""
    return with_views(names, body)


QUERIES: dict[str, str] = {}


KNN_BODY = """
, base AS (
  SELECT s.playlist_id, f.filepath, f.artist_mbid, s.weight, f.embedding
  FROM files f JOIN playlist_seeds s USING (filepath)
  WHERE s.weight > 0 AND f.embedding_success AND f.embedding_duration_seconds >= 60)
, cand AS (
  SELECT * FROM files
  WHERE embedding_success AND embedding_duration_seconds >= 60 AND artist_mbid IS NOT NULL)
, d AS (
  SELECT b.playlist_id, c.filepath,
         sum(list_distance(b.embedding, c.embedding) * b.weight
             / coalesce(exp((cf.score_value - 0.363023320190634) * 0.5), 1.0)) / sum(b.weight) AS raw
  FROM cand c CROSS JOIN base b
  LEFT JOIN cf_sym cf ON cf.artist_mbid_a = b.artist_mbid AND cf.artist_mbid_b = c.artist_mbid
  WHERE NOT EXISTS (SELECT 1 FROM playlist_seeds x
                    WHERE x.playlist_id = b.playlist_id AND x.filepath = c.filepath AND x.weight > 0)
  GROUP BY b.playlist_id, c.filepath
  HAVING sum(b.weight) > 0 AND min(list_distance(b.embedding, c.embedding)) > {min_distance})
, r AS (
  SELECT d.playlist_id, d.filepath, d.raw / coalesce(cw.weight, 1.0) AS distance
  FROM d LEFT JOIN {cw_table} cw ON cw.playlist_id = d.playlist_id AND cw.filepath = d.filepath
  WHERE coalesce(cw.weight, 1.0) > 0)
, ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY playlist_id ORDER BY distance, md5(filepath)) AS position
  FROM r)
SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position, k.filepath, f.recording_mbid, f.release_mbid,
       f.release_group_mbid, f.artist_mbid, coalesce(f.album_artist_mbid, f.artist_mbid) AS album_artist_mbid,
       round(k.distance, 6) AS distance, CAST(floor(f.track_length_seconds) AS INTEGER) AS track_length_seconds
FROM ranked k JOIN files f USING (filepath)
WHERE k.position <= {limit}
"""

NO_CW = "(SELECT CAST(NULL AS VARCHAR) AS playlist_id, CAST(NULL AS VARCHAR) AS filepath, CAST(NULL AS DOUBLE) AS weight WHERE false)"

QUERIES["knn_weighted"] = q(["files", "cf_sym", "playlist_seeds"],
                            KNN_BODY.format(min_distance=0.5, cw_table=NO_CW, limit=2000))


# --- listen aggregates ---------------------------------------------------------

QUERIES["knn_in_balls"] = q(["files", "cf_sym", "playlist_seeds"], KNN_BODY.format(min_distance=0.5, cw_table=NO_CW, limit=50))


def recency_base(as_of: str) -> str:
    days = f"CAST(trunc((epoch_us({as_of}) - epoch_us(l.listen_at_ts_utc)) / 86400000000.0) AS BIGINT)"
    return f"""
, base AS (
  SELECT l.username, l.recording_mbid, l.release_mbid, r.release_group_mbid, l.artist_mbids,
         l.listen_at_ts_utc, {days} AS listen_recency_days,
         exp(-0.1 * {days}) AS recency_pct,
         1 - least(exp(-0.1 * {days}), exp(-0.1)) AS inv_recency_pct
  FROM listens l JOIN releases r USING (release_mbid)
  WHERE l.recording_mbid IS NOT NULL AND l.release_mbid IS NOT NULL AND l.artist_mbids IS NOT NULL)"""


def skey(*cols: str) -> str:
    parts = " || '-' || ".join(f"coalesce(CAST({c} AS VARCHAR), '_dbt_utils_surrogate_key_null_')" for c in cols)
    return f"md5({parts})"


def entity_counts_sql(entity, dim, dim_cols, windows, distinct_of, key, as_of, source="base") -> str:
    sel = [f"max(d.{c}) AS {c}" for c in dim_cols]
    sel += [
        "min(b.listen_recency_days) AS listen_recency_days",
        "round(avg(b.listen_recency_days)) AS avg_listen_recency_days",
        "round(sum(b.recency_pct), 5) AS recency_score",
        "round(exp(sum(ln(b.inv_recency_pct))) * ln(count(*) + 1), 6) AS revisit_score",
        "count(*) AS lifetime_listen_count",
    ]
    sel += [f"count(DISTINCT b.{c}) AS lifetime_{lab}_count" for c, lab in distinct_of]
    for n in windows:
        cond = f"b.listen_at_ts_utc >= {as_of} - INTERVAL {n} DAY"
        sel.append(f"count(CASE WHEN {cond} THEN 1 END) AS last{n}_listen_count")
        sel += [f"count(DISTINCT CASE WHEN {cond} THEN b.{c} END) AS last{n}_{lab}_count" for c, lab in distinct_of]
    return f"""
, t AS (
  SELECT b.username, b.{entity}, {', '.join(sel)}
  FROM {source} b JOIN {dim} d ON b.{entity} = d.{entity}
  GROUP BY b.username, b.{entity})
SELECT {skey('username', entity)} AS {key}, * FROM t"""


_ART_SRC = ", base_a AS (SELECT b.*, UNNEST(b.artist_mbids) AS artist_mbid FROM base b)"

QUERIES["artist_listen_counts"] = q(
    ["listens", "releases", "artists"],
    recency_base(LISTEN_AS_OF) + _ART_SRC + entity_counts_sql(
        "artist_mbid", "artists", ["artist_name"], [14, 30, 60, 90],
        [("recording_mbid", "recording"), ("release_group_mbid", "release_group")],
        "user_artist_key", LISTEN_AS_OF, source="base_a"),
)
QUERIES["recording_listen_counts"] = q(
    ["listens", "releases", "recordings"],
    recency_base(LISTEN_AS_OF) + entity_counts_sql(
        "recording_mbid", "recordings", ["recording_title", "artist_credit_phrase"],
        [14, 30, 60, 90, 120, 150], [], "user_recording_key", LISTEN_AS_OF),
)
QUERIES["release_listen_counts"] = q(
    ["listens", "releases"],
    recency_base(LISTEN_AS_OF) + entity_counts_sql(
        "release_mbid", "releases", ["release_title", "artist_credit_phrase"],
        [14, 30, 60, 90], [("recording_mbid", "recording")], "user_release_key", LISTEN_AS_OF),
)
QUERIES["release_group_listen_counts"] = q(
    ["listens", "releases", "release_groups"],
    recency_base(LISTEN_AS_OF) + entity_counts_sql(
        "release_group_mbid", "release_groups", ["release_group_title", "artist_credit_phrase"],
        [14, 30, 60, 90, 120, 150], [("recording_mbid", "recording")], "user_release_group_key", LISTEN_AS_OF),
)


# --- library / activity --------------------------------------------------------

DEPS["name_map"] = []
QUERIES["name_map_flatten"] = q(["name_map"], "SELECT * REPLACE (array_to_string(artist_mbids, ',') AS artist_mbids) FROM name_map")

QUERIES["file_maps"] = q(["files", "name_map"], """
SELECT 'recording' AS entity, filepath, recording_mbid AS mbid FROM (
  SELECT f.filepath, m.recording_mbid FROM files f JOIN name_map m USING (recording_md5) WHERE m.recording_mbid IS NOT NULL
  UNION SELECT filepath, recording_mbid FROM files WHERE recording_mbid IS NOT NULL)
UNION ALL
SELECT 'release', filepath, release_mbid FROM (
  SELECT f.filepath, m.release_mbid FROM files f JOIN name_map m USING (recording_md5) WHERE m.release_mbid IS NOT NULL
  UNION SELECT filepath, release_mbid FROM files WHERE release_mbid IS NOT NULL)
UNION ALL
SELECT 'release-group', filepath, release_group_mbid FROM (
  SELECT f.filepath, m.release_group_mbid FROM files f JOIN name_map m USING (recording_md5) WHERE m.release_group_mbid IS NOT NULL
  UNION SELECT filepath, release_group_mbid FROM files WHERE release_group_mbid IS NOT NULL)
UNION ALL
SELECT 'artist', filepath, artist_mbid FROM (
  SELECT f.filepath, UNNEST(m.artist_mbids) AS artist_mbid FROM files f JOIN name_map m USING (recording_md5)
  WHERE len(m.artist_mbids) > 0
  UNION SELECT filepath, artist_mbid FROM files WHERE artist_mbid IS NOT NULL
  UNION SELECT filepath, album_artist_mbid FROM files WHERE album_artist_mbid IS NOT NULL)
""")

_DAYS = "CAST(trunc((epoch_us(" + LISTEN_AS_OF + ") - epoch_us(l.listen_at_ts_utc)) / 86400000000.0) AS BIGINT)"

QUERIES["file_listen_counts"] = q(["listens", "files", "map_file_recording"], f"""
, lfm AS (
  SELECT l.listen_md5, m.filepath, count(*) OVER (PARTITION BY l.listen_md5) AS k
  FROM listens l JOIN map_file_recording m USING (recording_mbid)
  WHERE l.recording_mbid IS NOT NULL)
, c AS (
  SELECT m.filepath, l.username,
         max(f.track_name) AS track_name, max(f.album_name) AS album_name,
         max(f.artist_name) AS artist_name, max(f.album_artist_name) AS album_artist_name,
         round(sum(1.0 / m.k), 6) AS lifetime_listen_count,
         round(sum(CASE WHEN l.listen_at_ts_utc >= {LISTEN_AS_OF} - INTERVAL 7 DAY THEN 1.0 / m.k ELSE 0 END), 6) AS last07_listen_count,
         round(sum(CASE WHEN l.listen_at_ts_utc >= {LISTEN_AS_OF} - INTERVAL 30 DAY THEN 1.0 / m.k ELSE 0 END), 6) AS last30_listen_count,
         round(sum(CASE WHEN l.listen_at_ts_utc >= {LISTEN_AS_OF} - INTERVAL 90 DAY THEN 1.0 / m.k ELSE 0 END), 6) AS last90_listen_count,
         round(sum(exp(-0.1 * {_DAYS})), 5) AS recency_score,
         round(exp(sum(ln(1 - least(exp(-0.1 * {_DAYS}), exp(-0.1))))) * ln(count(*) + 1), 6) AS revisit_score
  FROM lfm m JOIN listens l USING (listen_md5) JOIN files f USING (filepath)
  GROUP BY m.filepath, l.username)
SELECT {skey('filepath', 'username')} AS filepath_username_id, * FROM c
""")

QUERIES["file_play_rollup"] = q(["listens", "files", "map_file_recording"], """
, lfm AS (
  SELECT l.listen_md5, m.filepath, count(*) OVER (PARTITION BY l.listen_md5) AS k
  FROM listens l JOIN map_file_recording m USING (recording_mbid)
  WHERE l.recording_mbid IS NOT NULL)
SELECT m.filepath, CAST(round(sum(1.0 / m.k)) AS INTEGER) AS listen_count, max(l.listen_at_ts_utc) AS last_listen
FROM lfm m JOIN listens l USING (listen_md5)
GROUP BY m.filepath
HAVING CAST(round(sum(1.0 / m.k)) AS INTEGER) > 0
""")

QUERIES["daily_stats"] = q(["listens", "files", "map_file_recording"], f"""
, d AS (
  SELECT username, CAST(listen_at_ts_utc AS DATE) AS listen_date, recording_mbid, release_mbid,
         recording_mbid IN (SELECT recording_mbid FROM map_file_recording) AS mapped,
         count(*) AS n, sum(duration_ms) AS ms
  FROM listens
  WHERE CAST(listen_at_ts_utc AS DATE) >= CAST({LISTEN_AS_OF} AS DATE) - INTERVAL 90 DAY
  GROUP BY ALL)
SELECT {skey('username', 'listen_date')} AS user_date_key, username, listen_date,
       CAST(sum(n) AS BIGINT) AS count_listens, count(DISTINCT recording_mbid) AS count_recordings,
       count(DISTINCT release_mbid) AS count_releases, round(sum(ms) / 3600000.0, 6) AS sum_listen_hours,
       round(coalesce(CAST(sum(n) FILTER (mapped) AS DOUBLE) / sum(n) FILTER (recording_mbid IS NOT NULL), 0), 6)
         AS pct_listens_mapped_to_file
FROM d GROUP BY username, listen_date
""")

# Listens in the open interval (t, t + 24 h), by a range frame in microseconds.
_STARTS = """
, starts AS (
  SELECT * FROM (
    SELECT listen_md5 AS start_listen_md5, recording_mbid, username, listen_at_ts_utc AS period_start_at_utc,
           count(*) OVER (PARTITION BY username, recording_mbid ORDER BY epoch_us(listen_at_ts_utc)
                          RANGE BETWEEN 1 FOLLOWING AND 86399999999 FOLLOWING) AS next_24h_listen_count,
           track_name, release_name, artist_name
    FROM listens WHERE recording_mbid IS NOT NULL)
  WHERE next_24h_listen_count >= 5)"""

SPIKES_GLOBAL = _STARTS + """
, spikes AS (
  SELECT * FROM starts
  QUALIFY rank() OVER (PARTITION BY username, recording_mbid
                       ORDER BY next_24h_listen_count DESC, period_start_at_utc) = 1)"""
SPIKES_24H = _STARTS + """
, spikes AS (
  SELECT x.* FROM starts x WHERE NOT EXISTS (
    SELECT 1 FROM starts y
    WHERE y.username = x.username AND y.recording_mbid = x.recording_mbid
      AND abs(epoch_us(y.period_start_at_utc) - epoch_us(x.period_start_at_utc)) < 86400000000
      AND (-y.next_24h_listen_count, y.period_start_at_utc) < (-x.next_24h_listen_count, x.period_start_at_utc)))"""

QUERIES["play_spikes"] = q(["listens"], SPIKES_GLOBAL + "\nSELECT * FROM spikes")
QUERIES["play_spikes_24h"] = q(["listens"], SPIKES_24H + "\nSELECT * FROM spikes")

QUERIES["loved_tracks"] = q(["listens", "feedback", "files", "map_file_recording"], SPIKES_GLOBAL + """
, loves AS (
  SELECT username, recording_mbid, feedback_at AS love_at FROM feedback
  UNION ALL
  SELECT username, recording_mbid, period_start_at_utc FROM spikes)
SELECT l.username, m.filepath,
       array_to_string(list_sort(list_distinct(list(l.recording_mbid))), ',') AS recording_mbids,
       min(l.love_at) AS love_at
FROM loves l JOIN map_file_recording m USING (recording_mbid)
GROUP BY l.username, m.filepath
""")

QUERIES["unmapped_listens"] = q(["listens", "files", "map_file_recording"], f"""
SELECT l.* EXCLUDE (artist_mbids)
FROM listens l
WHERE l.recording_mbid IS NOT NULL
  AND l.listen_at_ts_utc > {LISTEN_AS_OF} - INTERVAL 14 DAY
  AND NOT EXISTS (SELECT 1 FROM map_file_recording m WHERE m.recording_mbid = l.recording_mbid)
""")

REVISIT_AS_OF = "TIMESTAMP '2024-05-15 00:00:00'"

QUERIES["revisit_releases"] = q(["listens", "releases", "release_groups"],
    recency_base(REVISIT_AS_OF) + entity_counts_sql(
        "release_group_mbid", "release_groups", ["release_group_title", "artist_credit_phrase"],
        [14, 30, 60, 90, 120, 150], [("recording_mbid", "recording")], "user_release_group_key", REVISIT_AS_OF)
    .replace("SELECT " + skey('username', 'release_group_mbid') + " AS user_release_group_key, * FROM t", """
SELECT release_group_mbid, release_group_title, artist_credit_phrase AS artist_name, username, revisit_score,
       lifetime_recording_count AS num_recordings, last150_listen_count - last90_listen_count AS listens_old,
       last90_listen_count AS listens_recent
FROM t
WHERE lifetime_recording_count BETWEEN 4 AND 20 AND last30_listen_count < 5
  AND (last150_listen_count - last90_listen_count) >= 5
  AND (last150_listen_count - last90_listen_count) >= lifetime_recording_count * 1.5
  AND revisit_score > 1.05"""))

QUERIES["revisit_tracks"] = q(["listens", "releases", "recordings", "files", "map_file_recording"],
    recency_base(REVISIT_AS_OF) + entity_counts_sql(
        "recording_mbid", "recordings", ["recording_title", "artist_credit_phrase"],
        [14, 30, 60, 90, 120, 150], [], "user_recording_key", REVISIT_AS_OF)
    .replace("SELECT " + skey('username', 'recording_mbid') + " AS user_recording_key, * FROM t", """
, recs AS (
  SELECT recording_mbid, recording_title, artist_credit_phrase AS artist_name, username, revisit_score,
         last150_listen_count - last90_listen_count AS listens_old, last90_listen_count AS listens_recent
  FROM t
  WHERE last90_listen_count <= 2 AND last14_listen_count = 0
    AND (last150_listen_count - last90_listen_count) >= 2 AND revisit_score > 1.05)
SELECT recording_mbid, username, filepath, recording_title, artist_name, artist_mbid, album_artist_mbid,
       revisit_score, listens_old, listens_recent
FROM (SELECT r.*, f.filepath, f.artist_mbid, f.album_artist_mbid,
             row_number() OVER (PARTITION BY r.recording_mbid, r.username ORDER BY md5(f.filepath), f.filepath) AS rn
      FROM recs r JOIN map_file_recording m USING (recording_mbid) JOIN files f USING (filepath)
      WHERE f.artist_mbid IS NOT NULL)
WHERE rn = 1"""))


# --- playlists with listen weights and recency penalties -----------------------

FILE_COUNTS_CTE = f"""
, lfm AS (
  SELECT l.listen_md5, m.filepath, count(*) OVER (PARTITION BY l.listen_md5) AS k
  FROM listens l JOIN map_file_recording m USING (recording_mbid)
  WHERE l.recording_mbid IS NOT NULL)
, fc AS (
  SELECT m.filepath, l.username,
         sum(1.0 / m.k) AS lifetime_listen_count,
         sum(CASE WHEN l.listen_at_ts_utc >= {LISTEN_AS_OF} - INTERVAL 30 DAY THEN 1.0 / m.k ELSE 0 END) AS last30_listen_count,
         round(sum(exp(-0.1 * {_DAYS})), 5) AS recency_score
  FROM lfm m JOIN listens l USING (listen_md5)
  GROUP BY m.filepath, l.username)"""

QUERIES["knn_predicate_weights"] = q(
    ["listens", "files", "map_file_recording", "cf_sym"],
    FILE_COUNTS_CTE + """
, seeds_raw AS (""" + ADAPTERS["playlist_seeds"] + """)
, playlist_seeds AS (
  SELECT s.playlist_id, s.username, s.filepath, ln(2 + greatest(coalesce(fc.lifetime_listen_count, 0), 0)) AS weight
  FROM seeds_raw s LEFT JOIN fc ON fc.username = s.username AND fc.filepath = s.filepath)
, recent AS (
  SELECT username, filepath, recency_score FROM fc WHERE last30_listen_count > 0 AND recency_score IS NOT NULL)
, cw AS (
  SELECT o.playlist_id, r.filepath, 1.0 / (1.0 + r.recency_score * 0.5) AS weight
  FROM (SELECT DISTINCT playlist_id, username FROM playlist_seeds) o JOIN recent r USING (username))"""
    + KNN_BODY.format(min_distance=0.5, cw_table="cw", limit=2000))


# --- flatten / scalar functions / recommendations --------------------------------

QUERIES["listen_flatten"] = q([], f"""
SELECT md5(CAST(event_id AS VARCHAR)) AS listen_md5,
       'u' || CAST(user_id % 10 AS VARCHAR) AS username,
       make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS listen_at_ts_utc,
       NULL::VARCHAR AS recording_msid,
       'Track ' || CAST({K} % 12 AS VARCHAR) AS track_name,
       'Artist ' || CAST({K} % 12 AS VARCHAR) AS artist_name,
       'Release ' || CAST({K} % 25 AS VARCHAR) AS release_name,
       {mbid('l', K + ' % 25')} AS release_mbid,
       {mbid('r', K + ' % 12')} AS recording_mbid,
       {mbid('a', K + ' % 12')} || ',' || {mbid('a', K + ' % 7')} AS artist_mbids,
       NULL::VARCHAR AS caa_release_mbid,
       CAST(round(value * 1000) AS INTEGER) AS duration_ms,
       CAST({K} % 12 + 1 AS INTEGER) AS tracknumber,
       NULL::TIMESTAMP AS _lb_insert_ts_utc
FROM events""")

_CANON = mbid('o', 'o_orderkey')
_RAW = f"""CASE WHEN o_orderkey % 5 = 0 THEN {_CANON}
            WHEN o_orderkey % 5 = 1 THEN upper({_CANON})
            WHEN o_orderkey % 5 = 2 THEN replace({_CANON}, '-', '')
            WHEN o_orderkey % 5 = 3 THEN 'urn:uuid:' || {_CANON}
            ELSE '{{' || substr({_CANON}, 1, 30) || '}}' END"""

QUERIES["uuid_year_casts"] = q([], f"""
, t AS (
  SELECT o_orderkey, {_RAW} AS raw_id,
         CASE WHEN o_orderkey % 7 = 0 THEN '19.5-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS date_text
  FROM orders)
, n AS (
  SELECT *, lower(replace(regexp_replace(replace(replace(raw_id, 'urn:', ''), 'uuid:', ''), '^[{{}}]+|[{{}}]+$', '', 'g'), '-', '')) AS s
  FROM t)
SELECT o_orderkey, raw_id,
       CASE WHEN regexp_full_match(raw_id, '[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}') THEN raw_id END AS strict_uuid,
       CASE WHEN regexp_full_match(s, '[0-9a-f]{{32}}')
            THEN regexp_replace(s, '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') END AS lenient_uuid,
       date_text,
       CASE WHEN regexp_full_match(substr(date_text, 1, 4), '[0-9]{{4}}') THEN CAST(substr(date_text, 1, 4) AS INTEGER) END AS year
FROM n""")

QUERIES["surrogate_keys"] = q([], f"""
SELECT l_orderkey, l_linenumber,
       md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' ||
           coalesce(CASE WHEN l_linenumber % 3 <> 0 THEN l_returnflag END, '_dbt_utils_surrogate_key_null_')) AS surrogate_key,
       md5(CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR)) AS pair_md5,
       md5(lower(trim(' Track ' || CAST(l_partkey AS VARCHAR))) || '-' || lower(trim(l_returnflag)) || '-' || lower(trim(l_linestatus))) AS recording_md5,
       md5('["' || l_returnflag || '", ' || CAST(l_orderkey AS VARCHAR) || ']') AS list_hash
FROM lineitem""")

QUERIES["dim_flatten"] = q(["artists"], "SELECT * FROM artists")

SIMILAR_CTE = f"""
, rows_ AS (
  SELECT md5(CAST(o_orderkey AS VARCHAR)) AS payload_id,
         CASE o_orderkey % 3 WHEN 0 THEN {mbid('a', 'l_suppkey % 25')}
                             WHEN 1 THEN {mbid('l', 'l_partkey % 25')}
                             ELSE {mbid('r', 'l_partkey % 12')} END AS mbid,
         CAST(l_quantity AS BIGINT) AS lc
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
, sua AS (
  SELECT {skey('payload_id', 'mbid')} AS similar_user_activity_id, mbid, listen_count,
         'u' || CAST(o_custkey % 10 AS VARCHAR) AS from_username, 'c' || CAST(o_custkey AS VARCHAR) AS to_username,
         (o_totalprice % 100) / 100.0 AS user_similarity,
         CASE WHEN o_orderkey % 2 = 0 THEN 'month' ELSE 'year' END AS time_range,
         make_timestamp(epoch_us(o_orderdate)) AS activity_from_ts,
         make_timestamp(epoch_us(o_orderdate) + 2592000000000) AS activity_to_ts,
         CASE o_orderkey % 3 WHEN 0 THEN 'artist' WHEN 1 THEN 'release' ELSE 'recording' END AS entity,
         payload_id AS ingest_payload_id
  FROM (SELECT payload_id, mbid, CAST(sum(lc) AS BIGINT) AS listen_count FROM rows_ GROUP BY 1, 2) x
  JOIN orders o ON md5(CAST(o.o_orderkey AS VARCHAR)) = x.payload_id
  WHERE mbid IS NOT NULL)"""

QUERIES["similar_activity"] = q([], (SIMILAR_CTE + """
SELECT similar_user_activity_id, mbid, listen_count, from_username, to_username,
       round(user_similarity, 6) AS user_similarity, time_range, activity_from_ts, activity_to_ts, entity, ingest_payload_id
FROM sua"""))

QUERIES["release_additions"] = q(["files", "name_map", "releases", "release_groups"], SIMILAR_CTE + """
, su AS (
  SELECT sua.from_username AS username, sua.time_range, r.release_group_mbid,
         sum(sua.user_similarity * log10(sua.listen_count)) AS score
  FROM sua JOIN releases r ON sua.mbid = r.release_mbid
  WHERE sua.entity = 'release'
  GROUP BY 1, 2, 3)
, known AS (
  SELECT DISTINCT release_group_mbid FROM (
    SELECT m.release_group_mbid FROM files f JOIN name_map m USING (recording_md5) WHERE m.release_group_mbid IS NOT NULL
    UNION SELECT release_group_mbid FROM files WHERE release_group_mbid IS NOT NULL))
, scores AS (
  SELECT su.*, row_number() OVER (PARTITION BY username, time_range ORDER BY score DESC, release_group_mbid) AS rank
  FROM su WHERE release_group_mbid NOT IN (SELECT release_group_mbid FROM known))
SELECT s.username, s.time_range, CAST(s.rank AS INTEGER) AS rank, s.release_group_mbid, g.artist_credit_phrase,
       g.release_group_title, g.release_group_year, round(s.score, 6) AS score
FROM scores s JOIN release_groups g USING (release_group_mbid)
WHERE s.rank <= 200""")

QUERIES["artist_recommends"] = q(["listens", "releases", "artists", "files", "name_map", "cf_sym"],
    recency_base(LISTEN_AS_OF) + _ART_SRC + """
, played AS (
  SELECT username, artist_mbid, count(*) AS plays FROM base_a WHERE artist_mbid IN (SELECT artist_mbid FROM artists)
  GROUP BY ALL HAVING count(*) > 50 ORDER BY plays DESC, username, artist_mbid LIMIT 500)
, shelf AS (
  SELECT artist_mbid, count(DISTINCT filepath) > 6 AS owned
  FROM (SELECT filepath, unnest([f.artist_mbid, album_artist_mbid] || coalesce(m.artist_mbids, [])) AS artist_mbid
        FROM files f LEFT JOIN name_map m USING (recording_md5))
  WHERE artist_mbid IS NOT NULL GROUP BY 1)
, told AS (
  SELECT c.artist_mbid_b AS artist_mbid, sum(exp(score_value - 0.35) * ln(plays)) AS total, max(exp(score_value - 0.35)) AS top,
         max(exp(score_value - 0.35)) FILTER (ours.owned) AS near_score,
         arg_max(c.artist_mbid_a, {'s': score_value, 'a': c.artist_mbid_a}) FILTER (ours.owned) AS near
  FROM played p JOIN cf_sym c ON p.artist_mbid = c.artist_mbid_a
  LEFT JOIN shelf ours ON ours.artist_mbid = c.artist_mbid_a LEFT JOIN shelf theirs ON theirs.artist_mbid = c.artist_mbid_b
  WHERE NOT coalesce(theirs.owned, false) GROUP BY 1)
SELECT t.artist_mbid, d.artist_name, n.artist_name AS most_similar_artist_name, d.tags_string, d.active_years,
       round(total, 6) AS total_score, round(top, 6) AS max_score, round(near_score, 6) AS max_similar_artist_score
FROM told t LEFT JOIN artists d USING (artist_mbid) LEFT JOIN artists n ON n.artist_mbid = t.near
WHERE t.near IS NOT NULL""")


# --- similarity ---------------------------------------------------------------------

DUMP_AGG_CTE = f"""
, agg0 AS (
  SELECT user_id, artist_mbid, CAST(sum(listen_count) AS BIGINT) AS listen_count
  FROM dump_records
  WHERE dump_date >= CAST({DUMP_AS_OF} AS DATE) - INTERVAL 365 DAY AND user_id <> 1
  GROUP BY 1, 2)
, agg AS (
  SELECT * FROM agg0 WHERE artist_mbid IN (
    SELECT artist_mbid FROM agg0 GROUP BY 1 HAVING count(DISTINCT user_id) >= 4))"""

QUERIES["dump_aggregate"] = q(["dump_records"], DUMP_AGG_CTE + "\nSELECT user_id, artist_mbid, listen_count FROM agg")

QUERIES["bm25"] = q(["dump_records"], DUMP_AGG_CTE + """
, s AS (SELECT CAST(max(user_id) + 1 AS DOUBLE) AS n, CAST(sum(listen_count) AS DOUBLE) AS tot FROM agg)
, df AS (SELECT artist_mbid, count(*) AS df FROM agg GROUP BY 1)
, rs AS (SELECT user_id, sum(listen_count) AS row_sum FROM agg GROUP BY 1)
SELECT a.user_id, a.artist_mbid,
       round(a.listen_count * 101.0 / (100.0 * (0.2 + 0.8 * rs.row_sum / (s.tot / s.n)) + a.listen_count)
             * (ln(s.n) - ln(1 + df.df)), 6) AS weight
FROM agg a JOIN df USING (artist_mbid) JOIN rs USING (user_id) CROSS JOIN s""")

QUERIES["embedding_cosine_search"] = q([], """
, v AS (SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, CAST(embedding AS DOUBLE[]) AS e, vec_id FROM embeddings)
SELECT a.id AS artist_mbid_a, b.id AS artist_mbid_b, round(list_cosine_similarity(a.e, b.e), 6) AS score_value
FROM v a JOIN v b ON a.id <> b.id WHERE a.vec_id % 100 = 0""")

QUERIES["dense_ids"] = q(["dump_records"], """
SELECT artist_mbid, row_number() OVER (ORDER BY artist_mbid) - 1 AS artist_id FROM (SELECT DISTINCT artist_mbid FROM dump_records)""")

QUERIES["folder_seeds"] = q(["files"], """
, r AS (
  SELECT n_name AS playlist_id, 'u' || CAST(n_nationkey % 10 AS VARCHAR) AS username,
         CASE n_nationkey % 3 WHEN 0 THEN 'lib/' || CAST(n_nationkey % 12 AS VARCHAR) || '/'
                              WHEN 1 THEN 'lib/' || CAST(n_nationkey % 10 AS VARCHAR) || '/0001' ELSE 'lib' END AS prefix
  FROM nation)
SELECT DISTINCT playlist_id, username, filepath FROM r JOIN files ON starts_with(filepath, prefix)""")



# --- sampling / universe ---------------------------------------------------------------

def uniform_sql(key: str) -> str:
    return f"((CAST(('0x' || substr(md5({key}), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0)"


_RR = recency_base(REVISIT_AS_OF) + entity_counts_sql(
    "release_group_mbid", "release_groups", ["release_group_title", "artist_credit_phrase"],
    [14, 30, 60, 90, 120, 150], [("recording_mbid", "recording")], "user_release_group_key", REVISIT_AS_OF
).replace("SELECT " + skey('username', 'release_group_mbid') + " AS user_release_group_key, * FROM t", """
, rr AS (
SELECT release_group_mbid, release_group_title, artist_credit_phrase AS artist_name, username, revisit_score,
       lifetime_recording_count AS num_recordings, last150_listen_count - last90_listen_count AS listens_old,
       last90_listen_count AS listens_recent
FROM t
WHERE lifetime_recording_count BETWEEN 4 AND 20 AND last30_listen_count < 5
  AND (last150_listen_count - last90_listen_count) >= 5
  AND (last150_listen_count - last90_listen_count) >= lifetime_recording_count * 1.5
  AND revisit_score > 1.05)""")

QUERIES["weighted_sample"] = q(["listens", "releases", "release_groups"], _RR + f"""
, k AS (
  SELECT rr.*, -(revisit_score - max(revisit_score) OVER (PARTITION BY username))
           - ln(-ln({uniform_sql("'0|' || username || '|' || release_group_mbid")})) AS g
  FROM rr)
SELECT release_group_mbid, release_group_title, artist_name, username, round(revisit_score, 6) AS revisit_score,
       num_recordings, listens_old, listens_recent
FROM (SELECT k.*, row_number() OVER (PARTITION BY username ORDER BY g DESC, username, release_group_mbid) AS rn FROM k)
WHERE rn <= 15""")

QUERIES["top_artists_sample"] = q(["listens", "releases", "artists"], recency_base(LISTEN_AS_OF) + _ART_SRC + f"""
, ac AS (
  SELECT b.username, b.artist_mbid, max(d.artist_name) AS artist_name,
         count(CASE WHEN b.listen_at_ts_utc >= {LISTEN_AS_OF} - INTERVAL 30 DAY THEN 1 END) AS listen_count
  FROM base_a b JOIN artists d ON b.artist_mbid = d.artist_mbid
  GROUP BY 1, 2)
SELECT username, artist_mbid, artist_name, listen_count FROM (
  SELECT ac.*, row_number() OVER (PARTITION BY username
           ORDER BY md5('0|' || username || '|' || artist_mbid), username, artist_mbid) AS rn
  FROM ac WHERE listen_count >= 15) WHERE rn <= 15""")

QUERIES["mbid_universe"] = q(["listens", "files", "name_map", "releases", "feedback"], SIMILAR_CTE + """
SELECT DISTINCT mbid, entity FROM (
  SELECT release_mbid AS mbid, 'release' AS entity FROM listens
  UNION ALL SELECT release_mbid, 'release' FROM files
  UNION ALL SELECT release_mbid, 'release' FROM name_map
  UNION ALL SELECT mbid, 'release' FROM sua WHERE entity = 'release'
  UNION ALL SELECT release_group_mbid, 'release-group' FROM files
  UNION ALL SELECT release_group_mbid, 'release-group' FROM name_map
  UNION ALL SELECT release_group_mbid, 'release-group' FROM releases
  UNION ALL SELECT recording_mbid, 'recording' FROM listens
  UNION ALL SELECT recording_mbid, 'recording' FROM name_map
  UNION ALL SELECT recording_mbid, 'recording' FROM files
  UNION ALL SELECT mbid, 'recording' FROM sua WHERE entity = 'recording'
  UNION ALL SELECT recording_mbid, 'recording' FROM feedback
  UNION ALL SELECT UNNEST(artist_mbids), 'artist' FROM listens
  UNION ALL SELECT artist_mbid, 'artist' FROM files
  UNION ALL SELECT album_artist_mbid, 'artist' FROM files
  UNION ALL SELECT UNNEST(artist_mbids), 'artist' FROM name_map
  UNION ALL SELECT mbid, 'artist' FROM sua WHERE entity = 'artist')
WHERE mbid IS NOT NULL""")


# --- merges / quality ---------------------------------------------------------------------

DUMP_TABLE_CTE = """
, t AS (
  SELECT slug, user_id, artist_mbid, max(dump_date) AS dump_date, CAST(sum(listen_count) AS BIGINT) AS listen_count
  FROM dump_records GROUP BY 1, 2, 3)
, target AS (SELECT * FROM t WHERE dump_date < DATE '1999-01-01')
, source AS (SELECT slug, user_id, artist_mbid, dump_date, listen_count * 10 AS listen_count
             FROM t WHERE dump_date >= DATE '1998-01-01')"""

QUERIES["upsert_merge"] = q(["dump_records"], DUMP_TABLE_CTE + """
SELECT coalesce(s.slug, t.slug) AS slug, coalesce(s.user_id, t.user_id) AS user_id,
       coalesce(s.artist_mbid, t.artist_mbid) AS artist_mbid,
       CASE WHEN t.slug IS NOT NULL THEN t.dump_date ELSE s.dump_date END AS dump_date,
       CASE WHEN s.slug IS NOT NULL THEN s.listen_count ELSE t.listen_count END AS listen_count
FROM target t FULL OUTER JOIN source s USING (slug, user_id, artist_mbid)""")

QUERIES["insert_absent"] = q(["dump_records"], DUMP_TABLE_CTE + """
SELECT * FROM target
UNION ALL
SELECT * FROM source s WHERE NOT EXISTS (
  SELECT 1 FROM target t WHERE t.slug = s.slug AND t.user_id = s.user_id AND t.artist_mbid = s.artist_mbid)""")

QUERIES["replace_group"] = q(["dump_records"], DUMP_TABLE_CTE + """
SELECT * FROM target WHERE slug NOT IN (SELECT DISTINCT slug FROM source)
UNION ALL SELECT * FROM source""")

QUERIES["table_append"] = q(["dump_records"], DUMP_TABLE_CTE + "\nSELECT * FROM t")
QUERIES["table_replace_group"] = QUERIES["replace_group"]
QUERIES["table_versions"] = q(["dump_records"], DUMP_TABLE_CTE + """
, y AS (SELECT * FROM target WHERE year(dump_date) = 1997)
, replaced AS (SELECT * FROM target WHERE slug NOT IN (SELECT slug FROM source) AND year(dump_date) <> 1997
               UNION ALL SELECT * FROM source)
, appended AS (SELECT * FROM replaced UNION ALL SELECT * FROM y)
, v AS (SELECT 0 AS version, 'refresh' AS kind, listen_count FROM target UNION ALL SELECT 1, 'replace', listen_count FROM replaced
        UNION ALL SELECT 2, 'append', listen_count FROM appended UNION ALL SELECT 3, 'refresh', listen_count FROM appended
        UNION ALL SELECT 4, 'refresh', listen_count FROM source)
SELECT version, kind, count(*) AS n_rows, CAST(sum(listen_count) AS BIGINT) AS listens FROM v GROUP BY 1, 2""")
QUERIES["stream_merge"] = q(["listens"], """
SELECT username, recording_mbid, listen_md5, listen_at_ts_utc FROM listens
QUALIFY row_number() OVER (PARTITION BY username, recording_mbid ORDER BY listen_at_ts_utc DESC, listen_md5 DESC) = 1""")
QUERIES["listen_count_totals"] = "\nUNION ALL\n".join(
    f"SELECT '{e}' AS entity, username, count(*) AS n_rows, CAST(sum(lifetime_listen_count) AS BIGINT) AS listens FROM ("
    + QUERIES[e.replace("-", "_") + "_listen_counts"] + ") GROUP BY username"
    for e in ("artist", "recording", "release", "release-group"))

QUERIES["incremental_merge"] = q([], f"""
, o AS (SELECT {mbid('o', 'o_orderkey % 5000')} AS mbid, o_orderdate AS ts_utc, o_totalprice AS value FROM orders)
, t0 AS (
  SELECT mbid, ts_utc, value FROM (
    SELECT o.*, row_number() OVER (PARTITION BY mbid ORDER BY ts_utc DESC, value DESC) AS rn
    FROM o WHERE ts_utc < TIMESTAMP '1999-01-01') WHERE rn = 1)
, fresh AS (
  SELECT mbid, ts_utc, value FROM (
    SELECT o.*, row_number() OVER (PARTITION BY mbid ORDER BY ts_utc DESC, value DESC) AS rn
    FROM o WHERE ts_utc > (SELECT max(ts_utc) FROM t0) - INTERVAL 5 MINUTE) WHERE rn = 1)
SELECT mbid, ts_utc, round(value, 6) AS value FROM t0 WHERE mbid NOT IN (SELECT mbid FROM fresh)
UNION ALL SELECT mbid, ts_utc, round(value, 6) FROM fresh""")

QUERIES["dq_unique"] = q(["dump_records"], """
SELECT slug, user_id, artist_mbid, count(*) AS n_records FROM dump_records
GROUP BY 1, 2, 3 HAVING count(*) > 1""")

QUERIES["dq_not_null_proportion"] = q(["files"], """
SELECT * FROM (
  SELECT 'album_artist_mbid' AS column_name, round(avg(CASE WHEN album_artist_mbid IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS proportion FROM files
  UNION ALL
  SELECT 'artist_mbid', round(avg(CASE WHEN artist_mbid IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) FROM files)
WHERE proportion < 0.9""")

QUERIES["dq_groupby_having"] = q(["files", "name_map", "map_file_recording"], """
SELECT filepath FROM map_file_recording GROUP BY filepath HAVING NOT (count(*) = 1)""")


# --- exports / streaming ---------------------------------------------------------------------

QUERIES["playlist_m3u8"] = q(["files", "cf_sym", "playlist_seeds"],
    KNN_BODY.format(min_distance=0.5, cw_table=NO_CW, limit=2000).replace(
        "SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position", ", top AS (SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position", 1)
    + """)
SELECT playlist_id,
       '#EXTM3U' || chr(10) || '#PLAYLIST:Songs like ' || playlist_id || chr(10) ||
       string_agg('#EXTINF:' || CAST(track_length_seconds AS VARCHAR) || ',' || chr(10) || filepath, chr(10) ORDER BY position) AS m3u8
FROM top GROUP BY playlist_id""")

QUERIES["stream_daily_stats"] = q(["listens"], """
SELECT username, CAST(listen_at_ts_utc AS DATE) AS listen_date, count(*) AS count_listens,
       count(DISTINCT recording_mbid) AS count_recordings, count(DISTINCT release_mbid) AS count_releases,
       round(sum(duration_ms) / 3600000.0, 6) AS sum_listen_hours,
       CAST(listen_at_ts_utc AS DATE) + INTERVAL 1 DAY <= (SELECT max(listen_at_ts_utc) - INTERVAL 1 HOUR FROM listens) AS is_closed
FROM listens
GROUP BY ALL""")

QUERIES["stream_dedupe"] = q(["listens"], "SELECT DISTINCT * EXCLUDE (artist_mbids) FROM listens")


# --- annotation queue ----------------------------------------------------------------------------

ENT_SQL = "['artist', 'release', 'release-group', 'recording'][(({x}) % 4) + 1]"


def ent(x: str) -> str:
    return ENT_SQL.replace("{x}", x)


ADAPTERS["qm"] = f"""SELECT {mbid('o', 'o_orderkey')} AS mbid, {ent('o_orderkey')} AS entity FROM orders"""

ADAPTERS["ann"] = f"""
SELECT {mbid('o', 'o_orderkey')} AS mbid,
       CASE WHEN o_orderkey % 9 = 0 THEN 'label' ELSE {ent('o_orderkey')} END AS entity,
       o_orderpriority <> '5-LOW' AS success,
       CASE WHEN o_orderpriority = '5-LOW'
            THEN ['HTTPSConnectionPool: status=None', 'HTTPError status=500', 'connection reset by peer'][o_orderkey % 3 + 1]
       END AS error,
       o_orderdate AS ts_utc
FROM orders WHERE o_orderstatus <> 'P'
UNION ALL
SELECT {mbid('c', 'c_custkey')}, 'artist', false, 'status=404 not found', TIMESTAMP '1995-01-01' + to_hours(c_custkey)
FROM customer"""

ADAPTERS["mbr"] = f"""
SELECT {ent('l_orderkey')} AS dump_entity, l_shipdate AS dump_timestamp, {mbid('o', 'l_orderkey')} AS mbid,
       {mbid('o', 'l_partkey')} AS c_mbid, {ent('l_partkey')} AS c_entity
FROM lineitem"""

_E = "('artist', 'release', 'release-group', 'recording')"

ADAPTERS["http_fail"] = f"""
SELECT mbid, entity FROM ann
WHERE NOT coalesce(success, true) AND entity IN {_E}
  AND (coalesce(error, '') NOT LIKE '%status=%' OR coalesce(error, '') LIKE '%status=None%')"""

ADAPTERS["lu"] = f"""
SELECT entity, mbid, max(ts) AS ts FROM (
  SELECT dump_entity AS entity, mbid, dump_timestamp AS ts FROM mbr WHERE dump_entity IN {_E}
  UNION ALL
  SELECT c_entity, c_mbid, dump_timestamp FROM mbr WHERE dump_entity IN {_E} AND c_entity IN {_E}
    AND c_mbid IS NOT NULL)
GROUP BY 1, 2"""

ADAPTERS["updated"] = """
SELECT a.mbid, a.entity FROM ann a JOIN lu USING (entity, mbid) WHERE a.ts_utc < lu.ts + INTERVAL 20 MINUTE"""

ADAPTERS["unannotated"] = f"""
SELECT m.mbid, m.entity FROM qm m WHERE m.entity IN {_E} AND m.mbid NOT IN (SELECT mbid FROM ann)"""

ADAPTERS["old"] = f"""
SELECT m.mbid, m.entity, a.ts_utc FROM qm m JOIN ann a USING (mbid)
WHERE a.ts_utc < TIMESTAMP '1996-01-01' AND m.entity IN {_E}"""

DEPS.update({
    "http_fail": ["ann"], "lu": ["mbr"], "updated": ["ann", "lu"], "unannotated": ["qm", "ann"],
    "old": ["qm", "ann"],
})

QUERIES["http_failures"] = q(["http_fail"], "SELECT * FROM http_fail")
QUERIES["updated_entities"] = q(["updated"], "SELECT * FROM updated")

QUERIES["refresh_queue"] = q(["unannotated", "http_fail", "updated", "old"], """
, u AS (
  SELECT mbid, entity, 0 AS prio, md5(mbid) AS ord, 'new' AS source FROM unannotated
  UNION ALL SELECT mbid, entity, 1, md5(mbid), 'http_fail' FROM http_fail
  UNION ALL SELECT mbid, entity, 2, md5(mbid), 'updated' FROM updated
  UNION ALL SELECT mbid, entity, 3, lpad(CAST(epoch_us(ts_utc) AS VARCHAR), 20, '0'), 'old' FROM old)
, b AS (
  SELECT * FROM (SELECT u.*, row_number() OVER (PARTITION BY mbid ORDER BY prio, ord, entity) AS rn FROM u) WHERE rn = 1)
SELECT mbid, entity, source, CAST(prio AS INTEGER) AS priority FROM b ORDER BY prio, ord, mbid LIMIT 200""")

QUERIES["queue_log"] = q(["unannotated", "http_fail", "updated", "old"], f"""
, c AS (
  SELECT 'new' AS source, entity, count(*) AS n FROM unannotated GROUP BY 2
  UNION ALL SELECT 'http_fail', entity, count(*) FROM http_fail GROUP BY 2
  UNION ALL SELECT 'updated', entity, count(*) FROM updated GROUP BY 2
  UNION ALL SELECT 'old', entity, count(*) FROM old GROUP BY 2)
, grid AS (
  SELECT s.source, e.entity FROM (VALUES ('new'), ('http_fail'), ('updated'), ('old')) s(source)
  CROSS JOIN (VALUES ('artist'), ('release'), ('release-group'), ('recording')) e(entity))
SELECT g.source, g.entity, CAST(coalesce(c.n, 0) AS BIGINT) AS queue_size
FROM grid g LEFT JOIN c USING (source, entity)""")

QUERIES["dangling_delete"] = q(["qm", "ann"], """
SELECT mbid, entity, ts_utc FROM ann
WHERE mbid NOT IN (
  SELECT mbid FROM ann WHERE mbid NOT IN (SELECT mbid FROM qm)
    AND NOT coalesce(success, true) AND ts_utc < TIMESTAMP '2001-08-01' - INTERVAL 1 MONTH)""")


def _ts(k: str) -> str:
    return f"TIMESTAMP '2024-01-01' + to_minutes(CAST({k} % 1000 AS INTEGER))"


QUERIES["artists_flatten"] = q([], f"""
, a AS (
  SELECT s_suppkey AS n, s_name, generate_series(0, s_suppkey % 4) AS ii FROM supplier WHERE s_suppkey % 17 <> 0)
, y AS (
  SELECT n, min(1990 + (n * 7 + i * 3) % 30) AS lo, max(1990 + (n * 7 + i * 3) % 30) AS hi
  FROM (SELECT n, UNNEST(ii) AS i FROM a) WHERE NOT (n % 9 = 0 AND i = 1) GROUP BY n)
, g AS (
  SELECT n, string_agg('tag ' || CAST((n + i) % 6 AS VARCHAR), ', ' ORDER BY (n * (i + 2)) % 5 DESC, 'tag ' || CAST((n + i) % 6 AS VARCHAR)) AS tags
  FROM (SELECT n, UNNEST([0, 1, 2]) AS i FROM a WHERE n % 6 <> 0) GROUP BY n)
SELECT {mbid('s', 'a.n')} AS artist_mbid, s_name AS artist_name, CASE WHEN a.n % 2 = 0 THEN 'Group' END AS artist_type,
       NULL::VARCHAR AS disambiguation, CAST(a.n % 4 + 1 AS INTEGER) AS release_count,
       CAST(lo AS INTEGER) AS earliest_release_year, CAST(hi AS INTEGER) AS latest_release_year,
       CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) AS active_years, tags AS tags_string,
       {_ts('a.n')} AS _ingest_insert_ts_utc, CAST(len(ii) AS INTEGER) AS n_releases
FROM a LEFT JOIN y USING (n) LEFT JOIN g USING (n)""")

QUERIES["recordings_flatten"] = q([], f"""
SELECT {mbid('r', 'p_partkey')} AS recording_mbid, p_name AS recording_title, CAST(p_partkey * 1000 AS INTEGER) AS recording_length_ms,
       p_brand AS artist_credit_phrase, {_ts('p_partkey')} AS _ingest_insert_ts_utc, 2 AS n_releases
FROM part WHERE p_partkey % 17 <> 0""")

QUERIES["releases_flatten"] = q([], f"""
SELECT {mbid('p', 'p_partkey')} AS release_mbid, p_name AS release_title,
       CASE WHEN p_partkey % 13 <> 0 THEN {mbid('g', 'p_partkey % 50')} END AS release_group_mbid,
       CAST(1950 + p_size AS INTEGER) AS release_year, p_brand AS artist_credit_phrase,
       {_ts('p_partkey')} AS _ingest_insert_ts_utc, 3 AS n_credits
FROM part WHERE p_partkey % 17 <> 0""")

QUERIES["release_groups_flatten"] = q([], f"""
SELECT {mbid('g', 'p_partkey')} AS release_group_mbid, p_type AS release_group_title,
       CAST(p_partkey % 3 + 1 AS VARCHAR) AS release_count,
       CASE WHEN p_partkey % 8 <> 0 THEN CAST(1960 + p_size AS INTEGER) END AS release_group_year,
       CASE WHEN p_partkey % 8 <> 0 THEN CAST(1960 + p_size AS VARCHAR) || '-01-01' END AS first_release_date,
       'Album' AS release_group_type, 'Album' AS release_group_primary_type, p_brand AS artist_credit_phrase,
       {_ts('p_partkey')} AS _ingest_insert_ts_utc
FROM part WHERE p_partkey % 17 <> 0""")

QUERIES["map_recording_release"] = q([], f"""
SELECT {mbid('r', 'p_partkey')} AS recording_mbid, UNNEST([{mbid('p', 'p_partkey')},
       CASE WHEN p_partkey % 5 <> 0 THEN {mbid('p', '(p_partkey + 1)')} END]) AS release_mbid
FROM part WHERE p_partkey % 17 <> 0""")

QUERIES["map_release_group_artist"] = q([], f"""
SELECT {mbid('g', 'p_partkey')} AS release_group_mbid, {mbid('s', '(p_partkey % 100 + 1)')} AS artist_mbid FROM part WHERE p_partkey % 17 <> 0
UNION
SELECT {mbid('g', 'p_partkey')}, {mbid('s', '(p_partkey % 7 + 1)')} FROM part WHERE p_partkey % 17 <> 0""")

_EDGES = f"""
, edges AS (
  SELECT DISTINCT {mbid('s', 'n')} AS src, {mbid('p', '((n * 5 + i) % 400 + 1)')} AS dst, 'release' AS dst_entity
  FROM (SELECT s_suppkey AS n, UNNEST(generate_series(0, s_suppkey % 4)) AS i FROM supplier WHERE s_suppkey % 17 <> 0)
  UNION
  SELECT {mbid('p', 'p_partkey')}, {mbid('g', 'p_partkey % 50')}, 'release-group'
  FROM part WHERE p_partkey % 17 <> 0 AND p_partkey % 13 <> 0)"""

QUERIES["dependents"] = q([], _EDGES + "\nSELECT * FROM edges")

# two rounds are all there can be: artist -> release -> release group
QUERIES["dependents_closure"] = q([], _EDGES + f"""
, known AS (SELECT {mbid('s', 's_suppkey')} AS mbid FROM supplier UNION SELECT {mbid('p', 'p_partkey')} FROM part WHERE p_partkey % 3 = 0)
, one AS (SELECT DISTINCT dst AS mbid, dst_entity AS entity FROM edges
          WHERE src IN (SELECT {mbid('s', 's_suppkey')} FROM supplier) AND dst NOT IN (SELECT mbid FROM known))
, two AS (SELECT DISTINCT dst AS mbid, dst_entity AS entity FROM edges
          WHERE src IN (SELECT mbid FROM one) AND dst NOT IN (SELECT mbid FROM known) AND dst NOT IN (SELECT mbid FROM one))
SELECT *, 1 AS depth FROM one UNION ALL SELECT *, 2 FROM two""")

QUERIES["gap_packets"] = q([], f"""
, d AS (SELECT {ent('l_orderkey')} AS entity, epoch_us(l_shipdate) // 3600000000 AS packet_number FROM lineitem)
, last AS (SELECT entity, max(packet_number) AS last FROM d GROUP BY 1)
, e AS (SELECT * FROM (VALUES ('artist'), ('release'), ('release-group'), ('recording'), ('label')) t(entity))
, s AS (SELECT e.entity, coalesce(l.last, 280512 - 169) + 1 AS start FROM e LEFT JOIN last l USING (entity))
SELECT entity, CAST(UNNEST(generate_series(start, 280512)) AS BIGINT) AS packet_number FROM s WHERE start <= 280512""")

QUERIES["inbox"] = q([], """
SELECT filepath, birth_at FROM (
  SELECT 'lib/' || CAST(label AS VARCHAR) || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.flac' AS filepath,
         TIMESTAMP '2024-01-01' + to_minutes(vec_id) AS birth_at FROM embeddings)
WHERE birth_at > TIMESTAMP '2024-01-01 04:00:00'""")

QUERIES["stale_collections"] = q([], """
, c AS (
  SELECT 'coll-' || CAST(c_custkey AS VARCHAR) AS collection_name, 'u' || CAST(c_custkey % 10 AS VARCHAR) AS username,
         CASE WHEN c_custkey % 5 = 0 THEN []::INTEGER[] ELSE [c_nationkey % 24, (c_nationkey + 12) % 24] END AS hours,
         CASE WHEN c_custkey % 7 = 0 THEN NULL
              ELSE TIMESTAMP '2024-05-18 12:00:00' - to_hours(c_custkey % 48) END AS refreshed_at_utc
  FROM customer)
, t AS (
  SELECT collection_name, max(cand) AS refresh_target FROM (
    SELECT collection_name, TIMESTAMP '2024-05-18 00:00:00' + to_hours(UNNEST(hours)) AS cand FROM c
    UNION ALL
    SELECT collection_name, TIMESTAMP '2024-05-17 00:00:00' + to_hours(UNNEST(hours)) FROM c)
  WHERE cand <= TIMESTAMP '2024-05-18 12:00:00' GROUP BY 1)
SELECT c.collection_name, c.username, t.refresh_target,
       (c.refreshed_at_utc IS NULL OR len(c.hours) = 0 OR c.refreshed_at_utc < t.refresh_target) AS is_stale
FROM c LEFT JOIN t USING (collection_name)""")

QUERIES["regex_exclude"] = q(["files"], """
SELECT f.filepath FROM files f WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT 'lib/' || CAST(r_regionkey * 2 AS VARCHAR) || '/00' || CAST(r_regionkey AS VARCHAR) AS pattern FROM region) p
  WHERE regexp_matches(f.filepath, '^(?:' || p.pattern || ')'))""")

QUERIES["anti_new_recordings"] = q(["files"], """
SELECT DISTINCT recording_md5, track_name AS recording_name, album_name AS release_name, artist_name
FROM files
WHERE recording_md5 IS NOT NULL AND length(concat(artist_name, track_name, album_name)) < 245
  AND recording_md5 NOT IN (
    SELECT md5('Track ' || CAST(n % 10 AS VARCHAR) || '-Album ' || CAST(n % 8 AS VARCHAR) || '-Artist ' || CAST(n % 10 AS VARCHAR))
    FROM (SELECT DISTINCT p_partkey % 40 AS n FROM part))""")

QUERIES["loves_diff"] = q(["listens", "feedback", "files", "map_file_recording"], SPIKES_GLOBAL + FILE_COUNTS_CTE + """
, loved AS (
  SELECT DISTINCT l.username, m.filepath FROM (
    SELECT username, recording_mbid FROM feedback UNION ALL SELECT username, recording_mbid FROM spikes) l
  JOIN map_file_recording m USING (recording_mbid))
, starred AS (
  SELECT username, filepath FROM fc WHERE last30_listen_count > 0 AND recency_score IS NOT NULL)
SELECT username, filepath, 'to_star' AS direction FROM (SELECT * FROM loved EXCEPT SELECT * FROM starred)
UNION ALL
SELECT username, filepath, 'to_submit' FROM (SELECT * FROM starred EXCEPT SELECT * FROM loved)""")

QUERIES["playlist_file_counts"] = q(["files"], """
, t AS (
  SELECT filepath, 'pl' || CAST(pn AS VARCHAR) AS playlist_id, pn % 4 AS cid,
         ['top-artists', 'smart-mix', 'loved-tracks', 'revisit-tracks'][pn % 4 + 1] AS collection_name,
         'u' || CAST(pn % 4 % 2 AS VARCHAR) AS username
  FROM (SELECT 'lib/' || CAST(label AS VARCHAR) || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.flac' AS filepath,
               UNNEST([vec_id % 7, (vec_id + 4) % 7 + 7]) AS pn FROM embeddings))
, agg AS (
  SELECT username, filepath, count(DISTINCT playlist_id) AS playlist_count,
         array_to_string(list_sort(list_distinct(list(collection_name))), ',') AS collection_names
  FROM t WHERE collection_name NOT IN ('loved-tracks', 'revisit-tracks', 'revisit-releases')
  GROUP BY 1, 2 HAVING count(DISTINCT playlist_id) > 1)
SELECT a.username, a.filepath, f.track_name, f.album_name, f.artist_name, f.album_artist_name,
       a.playlist_count, a.collection_names
FROM agg a JOIN files f USING (filepath)""")


# --- dump scan / collections ---------------------------------------------------------------

QUERIES["listen_dump_scan"] = q([], f"""
, j AS (
  SELECT o_custkey AS user_id, l_linenumber AS n, {mbid('s', 'l_suppkey')} AS a, {mbid('s', 'l_suppkey + 1')} AS b
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
, ids AS (
  SELECT user_id, a AS artist_mbid FROM j WHERE n IN (1, 2, 3, 6, 7)
  UNION ALL SELECT user_id, b FROM j WHERE n = 7)
SELECT user_id, artist_mbid, count(*) AS listen_count FROM ids GROUP BY 1, 2""")

QUERIES["loved_collection"] = q(["listens", "feedback", "files", "map_file_recording"], SPIKES_GLOBAL + """
, loves AS (
  SELECT username, recording_mbid, feedback_at AS love_at FROM feedback
  UNION ALL SELECT username, recording_mbid, period_start_at_utc FROM spikes)
, lt AS (
  SELECT l.username, m.filepath, min(l.love_at) AS love_at
  FROM loves l JOIN map_file_recording m USING (recording_mbid) GROUP BY 1, 2)
SELECT lt.username, CAST(row_number() OVER (PARTITION BY lt.username ORDER BY lt.love_at DESC, lt.filepath) - 1 AS INTEGER) AS order_index,
       lt.filepath, CAST(floor(f.track_length_seconds) AS INTEGER) AS track_length_seconds
FROM lt JOIN files f USING (filepath)""")


QUERIES["local_files_view"] = q([], f"""
, m AS (
  SELECT 'lib/' || CAST(label AS VARCHAR) || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.flac' AS filepath,
         md5('Track ' || CAST(vec_id % 10 AS VARCHAR) || '-Album ' || CAST(vec_id % 25 % 8 AS VARCHAR)
             || '-Artist ' || CAST(label AS VARCHAR)) AS recording_md5,
         least(TIMESTAMP '2023-01-01' + to_hours(vec_id), TIMESTAMP '2023-01-01' + to_hours(vec_id * 7 % 1000)) AS created,
         'Track ' || CAST(vec_id % 10 AS VARCHAR) AS track_name,
         'Album ' || CAST(vec_id % 25 % 8 AS VARCHAR) AS album_name,
         'Artist ' || CAST(label AS VARCHAR) AS artist_name,
         CASE WHEN vec_id % 4 <> 0 THEN 'Artist ' || CAST(vec_id % 13 AS VARCHAR) END AS album_artist_name,
         CASE WHEN vec_id % 9 = 0 THEN '19.5' ELSE CAST(1990 + vec_id % 30 AS VARCHAR) || '-05-01' END AS track_date,
         CAST(30 + vec_id % 300 AS DOUBLE) AS track_length_seconds,
         CASE WHEN vec_id % 11 = 0 THEN NULL ELSE {mbid('r', 'vec_id % 10')} END AS recording_mbid,
         {mbid('l', 'vec_id % 25')} AS release_mbid,
         {mbid('g', 'vec_id % 25 % 8')} AS release_group_mbid,
         {mbid('a', 'label')} AS artist_mbid,
         CASE WHEN vec_id % 4 <> 0 THEN {mbid('a', 'vec_id % 13')} END AS album_artist_mbid,
         vec_id
  FROM embeddings)
SELECT filepath, recording_md5,
       CASE WHEN vec_id % 3 = 0 THEN least(TIMESTAMP '2022-06-01' + to_minutes(vec_id), created) ELSE created END AS file_created_at,
       track_name, album_name, artist_name, album_artist_name, track_date, track_length_seconds,
       recording_mbid, release_mbid, release_group_mbid, artist_mbid, album_artist_mbid,
       CASE WHEN regexp_full_match(substr(track_date, 1, 4), '[0-9]{{4}}') THEN CAST(substr(track_date, 1, 4) AS INTEGER) END AS track_year,
       CASE WHEN vec_id % 37 = 0 THEN false WHEN vec_id % 5 <> 0 THEN true END AS embedding_success,
       CASE WHEN vec_id % 37 = 0 OR vec_id % 5 <> 0 THEN CAST(least(30 + vec_id % 300, 90) AS INTEGER) END AS embedding_duration_seconds,
       CASE WHEN vec_id % 37 <> 0 AND vec_id % 5 <> 0 THEN 64 END AS embedding_dims
FROM m""")


QUERIES["play_count_export"] = q(["listens", "releases", "artists", "files", "name_map", "map_file_recording"],
    recency_base(LISTEN_AS_OF) + _ART_SRC + """
, ac AS (SELECT b.username, b.artist_mbid AS key, count(*) AS n, min(b.listen_recency_days) AS d
         FROM base_a b JOIN artists x ON b.artist_mbid = x.artist_mbid GROUP BY 1, 2)
, rc AS (SELECT b.username, b.release_mbid AS key, count(*) AS n, min(b.listen_recency_days) AS d
         FROM base b JOIN releases x ON b.release_mbid = x.release_mbid GROUP BY 1, 2)
, lfm AS (
  SELECT l.listen_md5, m.filepath, count(*) OVER (PARTITION BY l.listen_md5) AS k
  FROM listens l JOIN map_file_recording m USING (recording_mbid) WHERE l.recording_mbid IS NOT NULL)
, fr AS (
  SELECT m.filepath AS key, CAST(round(sum(1.0 / m.k)) AS BIGINT) AS n, max(l.listen_at_ts_utc) AS last_listen
  FROM lfm m JOIN listens l USING (listen_md5) GROUP BY 1 HAVING CAST(round(sum(1.0 / m.k)) AS INTEGER) > 0)
, cat AS (
  SELECT DISTINCT item_type, key FROM (
    SELECT 'media_file' AS item_type, filepath AS key FROM files
    UNION ALL SELECT 'artist', artist_mbid FROM files WHERE artist_mbid IS NOT NULL
    UNION ALL SELECT 'artist', album_artist_mbid FROM files WHERE album_artist_mbid IS NOT NULL
    UNION ALL SELECT 'album', release_mbid FROM files WHERE release_mbid IS NOT NULL))
, u AS (
  SELECT NULL::VARCHAR AS username, 'media_file' AS item_type, key, n AS play_count, CAST(last_listen AS DATE) AS play_date FROM fr
  UNION ALL SELECT username, 'artist', key, n, CAST(DATE '2024-01-31' - CAST(d AS INTEGER) AS DATE) FROM ac
  UNION ALL SELECT username, 'album', key, n, CAST(DATE '2024-01-31' - CAST(d AS INTEGER) AS DATE) FROM rc)
SELECT u.username, u.item_type, md5(u.item_type || ':' || u.key) AS item_id, CAST(u.play_count AS BIGINT) AS play_count, u.play_date
FROM u JOIN cat USING (item_type, key)""")


QUERIES["ingest_window"] = q(["listens"], """
, users AS (SELECT DISTINCT 'u' || CAST(c_custkey % 20 AS VARCHAR) AS username FROM customer)
, last AS (SELECT username, max(listen_at_ts_utc) AS last_listen_at FROM listens GROUP BY 1)
SELECT u.username, l.last_listen_at, l.last_listen_at - INTERVAL 3 DAY AS from_ts,
       TIMESTAMP '2024-01-29 12:00:00' AS to_ts,
       (l.last_listen_at IS NULL OR l.last_listen_at - INTERVAL 3 DAY < TIMESTAMP '2024-01-29 12:00:00') AS valid
FROM users u LEFT JOIN last l USING (username)""")

QUERIES["signature_roundtrip"] = q([], f"""
, t AS (SELECT DISTINCT 'pl' || CAST(pn AS VARCHAR) AS pid, pn % 4 AS cid,
               ['top-artists', 'smart-mix', 'loved-tracks', 'revisit-tracks'][pn % 4 + 1] AS collection_name
        FROM (SELECT UNNEST([vec_id % 7, (vec_id + 4) % 7 + 7]) AS pn FROM embeddings))
, p AS (SELECT {mbid('p', 'pid')} AS playlist_id, {mbid('c', 'cid')} AS collection_id, collection_name FROM t)
SELECT playlist_id, collection_name,
       CASE WHEN substr(playlist_id, 1, 1) IN ('0', '1', '2', '3', '4') THEN NULL ELSE playlist_id END AS sig_playlist_id,
       CASE WHEN substr(playlist_id, 1, 1) IN ('0', '1', '2', '3', '4') THEN NULL ELSE collection_id END AS sig_collection_id,
       CASE WHEN substr(playlist_id, 1, 1) IN ('0', '1', '2', '3', '4') THEN NULL ELSE 0 END AS sig_order_index,
       CASE WHEN substr(playlist_id, 1, 1) IN ('0', '1', '2', '3', '4') THEN NULL ELSE '2024-05-18T12:30:00Z' END AS signed_at
FROM p""")


QUERIES["revisit_release_playlists"] = q(["listens", "releases", "release_groups", "files", "name_map"], _RR + f"""
, k AS (
  SELECT rr.*, -(revisit_score - max(revisit_score) OVER (PARTITION BY username))
           - ln(-ln({uniform_sql("'0|' || username || '|' || release_group_mbid")})) AS g
  FROM rr)
, sampled AS (
  SELECT * FROM (SELECT k.*, row_number() OVER (PARTITION BY username ORDER BY g DESC, username, release_group_mbid) AS rn FROM k)
  WHERE rn <= 15)
, rgm AS (
  SELECT DISTINCT filepath, release_group_mbid FROM (
    SELECT f.filepath, m.release_group_mbid FROM files f JOIN name_map m USING (recording_md5) WHERE m.release_group_mbid IS NOT NULL
    UNION SELECT filepath, release_group_mbid FROM files WHERE release_group_mbid IS NOT NULL))
, j AS (
  SELECT s.username, s.release_group_mbid, s.release_group_title, s.artist_name, f.filepath, f.recording_mbid,
         f.release_mbid, f.artist_mbid, coalesce(f.album_artist_mbid, f.artist_mbid) AS album_artist_mbid,
         CAST(floor(f.track_length_seconds) AS INTEGER) AS track_length_seconds
  FROM sampled s JOIN rgm USING (release_group_mbid) JOIN files f ON f.filepath = rgm.filepath)
, have AS (
  SELECT username, release_group_mbid,
         row_number() OVER (PARTITION BY username ORDER BY artist_name, release_group_title, release_group_mbid) AS playlist_index
  FROM (SELECT DISTINCT username, release_group_mbid, release_group_title, artist_name FROM j))
SELECT j.username, CAST(h.playlist_index AS INTEGER) AS playlist_index,
       'Revisit Release ' || CAST(h.playlist_index AS VARCHAR) AS title,
       'Revisit: ' || j.release_group_title || ' - ' || j.artist_name AS description,
       CAST(row_number() OVER (PARTITION BY j.username, j.release_group_mbid ORDER BY j.filepath) - 1 AS INTEGER) AS order_index,
       j.filepath, j.recording_mbid, j.release_mbid, j.release_group_mbid, j.artist_mbid, j.album_artist_mbid,
       j.track_length_seconds
FROM j JOIN have h USING (username, release_group_mbid)""")


QUERIES["collection_registry"] = q(["listens"], """
, existing AS (
  SELECT 'coll-' || CAST(c_custkey AS VARCHAR) AS collection_name, 'u' || CAST(c_custkey % 10 AS VARCHAR) AS username,
         CASE WHEN c_custkey % 5 = 0 THEN []::INTEGER[] ELSE [c_nationkey % 24, (c_nationkey + 12) % 24] END AS hours,
         CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE TIMESTAMP '2024-05-18 12:00:00' - to_hours(c_custkey % 48) END AS refreshed_at_utc
  FROM customer)
, defs AS (SELECT * FROM (VALUES ('loved-tracks', NULL::INTEGER[]), ('revisit-tracks', NULL::INTEGER[]),
                                 ('revisit-releases', [7]), ('smart-mixes', [7]), ('top-artists', [7])) d(collection_name, hours))
, want AS (SELECT d.collection_name, u.username, d.hours, NULL::TIMESTAMP AS refreshed_at_utc
           FROM (SELECT DISTINCT username FROM listens) u CROSS JOIN defs d)
, merged AS (
  SELECT * FROM existing
  UNION ALL SELECT * FROM want w WHERE NOT EXISTS (
    SELECT 1 FROM existing e WHERE e.username = w.username AND e.collection_name = w.collection_name))
SELECT collection_name, username, array_to_string(hours, ',') AS refresh_at_hours_utc, refreshed_at_utc FROM merged""")


QUERIES["entity_dump_quarantine"] = q([], f"""
SELECT CAST(packet AS VARCHAR) || '-' || entity AS slug, count(*) AS n_bad, 'oops' AS bad
FROM (SELECT p_partkey // 300 AS packet, {ent('p_partkey // 300')} AS entity FROM part WHERE p_partkey % 60 = 1)
GROUP BY 1""")

QUERIES["entity_dump_broken"] = q([], f"""
SELECT CAST(p_partkey // 1000 AS VARCHAR) || '-release-group' AS slug,
       count(*) FILTER (p_partkey % 10 NOT IN (5, 7)) AS n_objects,
       md5(string_agg({mbid('p', 'p_partkey')}, ',' ORDER BY {mbid('p', 'p_partkey')}) FILTER (p_partkey % 10 NOT IN (5, 7))) AS ids_md5,
       count(*) FILTER (p_partkey % 10 IN (3, 5, 7)) AS n_bad
FROM part GROUP BY 1""")

QUERIES["entity_dump_scan"] = q([], f"""
, p AS (SELECT p_partkey AS k, p_partkey // 300 AS packet FROM part WHERE p_partkey % 13 <> 0)
, e AS (SELECT k, packet, {ent('packet')} AS entity FROM p)
, c AS (
  SELECT k, list_sort(CASE
      WHEN entity = 'release-group' THEN ['artist:' || {mbid('a', 'k % 11')}, 'artist:' || {mbid('a', '(k + 1) % 11')}]
      WHEN entity = 'release' THEN ['release-group:' || {mbid('g', 'k % 50')}, 'artist:' || {mbid('a', 'k % 11')},
                                   'artist:' || {mbid('a', '(k + 1) % 11')}]
      ELSE []::VARCHAR[] END) AS cl
  FROM e)
SELECT CAST(e.packet AS VARCHAR) || '-' || e.entity AS slug, CAST(e.packet AS BIGINT) AS packet_number, e.entity,
       {mbid('p', 'e.k')} AS mbid, CAST(len(c.cl) AS INTEGER) AS n_containers, array_to_string(c.cl, ',') AS containers
FROM e JOIN c USING (k)""")


_PARENTS = """
, parents AS (
  SELECT slug, max(dump_date) AS dump_date,
         CAST(max(dump_date) AS TIMESTAMP) + to_hours(CAST(count(*) % 5 AS INTEGER)) AS ftp_modify_ts
  FROM dump_records GROUP BY slug)"""

QUERIES["retention_drop"] = q(["dump_records"], _PARENTS + """
SELECT slug, count(*) AS n_records, CAST(sum(listen_count) AS BIGINT) AS listens
FROM dump_records WHERE slug IN (SELECT slug FROM parents WHERE dump_date >= DATE '1996-08-01')
GROUP BY slug""")

QUERIES["new_or_modified"] = q(["dump_records"], _PARENTS + """
, known AS (
  SELECT slug, CASE WHEN dayofmonth(dump_date) % 2 = 0 THEN ftp_modify_ts - INTERVAL 1 HOUR ELSE ftp_modify_ts END AS stored
  FROM parents WHERE dump_date < DATE '2000-01-01')
SELECT p.slug, p.dump_date, p.ftp_modify_ts, k.stored IS NULL AS is_new
FROM parents p LEFT JOIN known k USING (slug)
WHERE k.stored IS NULL OR p.ftp_modify_ts > k.stored""")

QUERIES["column_update"] = q([], """
SELECT 'lib/' || CAST(label AS VARCHAR) || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.flac' AS filepath,
       vec_id % 37 <> 0 AS success,
       CASE WHEN label <> 3 AND vec_id % 37 <> 0 AND vec_id % 5 <> 0 THEN 64 END AS conditioned_dims
FROM embeddings""")

QUERIES["key_set_checks"] = q(["artists"], SIMILAR_CTE + """
, known AS (SELECT DISTINCT artist_mbid FROM artists)
, dump AS (SELECT DISTINCT mbid AS artist_mbid FROM sua WHERE entity = 'artist')
SELECT artist_mbid, 'both' AS side FROM (SELECT * FROM known INTERSECT SELECT * FROM dump)
UNION ALL SELECT artist_mbid, 'known_only' FROM (SELECT * FROM known EXCEPT SELECT * FROM dump)
UNION ALL SELECT artist_mbid, 'dump_only' FROM (SELECT * FROM dump EXCEPT SELECT * FROM known)""")

QUERIES["first_per_key"] = q(["listens"], """
SELECT username, recording_mbid, listen_md5, listen_at_ts_utc FROM (
  SELECT *, row_number() OVER (PARTITION BY username, recording_mbid ORDER BY listen_at_ts_utc, listen_md5) AS rn
  FROM listens) WHERE rn = 1""")

QUERIES["path_and_flags"] = q(["files"], """
SELECT filepath,
       CASE WHEN starts_with(filepath, 'lib/') THEN substr(filepath, 5) ELSE filepath END AS relative,
       '/music/' || CASE WHEN starts_with(filepath, 'lib/') THEN substr(filepath, 5) ELSE filepath END AS absolute,
       ['1', 'TRUE', ' true ', '0', 'no'][vec_id % 5 + 1] AS flag_text,
       lower(trim(['1', 'TRUE', ' true ', '0', 'no'][vec_id % 5 + 1])) IN ('1', 'true') AS flag
FROM files""")


QUERIES["artist_stats_flatten"] = q([], f"""
SELECT {mbid('s', 's_suppkey')} AS artist_mbid, 'all_time' AS stats_range, s_name AS artist_name,
       make_timestamp(1700000000::BIGINT * 1000000) AS from_ts,
       make_timestamp((1700000000 + s_suppkey * 3600) * 1000000) AS to_ts,
       make_timestamp((1700000000 + s_suppkey * 60) * 1000000) AS last_updated,
       CAST(s_nationkey * 3 AS INTEGER) AS total_user_count, CAST(trunc(abs(s_acctbal)) AS INTEGER) AS total_listen_count,
       TIMESTAMP '2024-02-01' AS _insert_ts_utc, CAST(s_suppkey % 4 + 1 AS INTEGER) AS n_listeners
FROM supplier WHERE s_suppkey % 6 <> 0""")

QUERIES["listen_page_scan"] = q([], f"""
SELECT md5('["' || username || '", "' || msid || '", ' || CAST(sec AS VARCHAR) || ']') AS listen_md5,
       username, make_timestamp(sec * 1000000) AS listen_at_ts_utc, msid AS recording_msid, track_name
FROM (SELECT 'u' || CAST(user_id % 10 AS VARCHAR) AS username, CAST(floor(epoch(ts)) AS BIGINT) AS sec,
             md5('msid' || CAST({K} % 12 AS VARCHAR)) AS msid, 'Track ' || CAST({K} % 12 AS VARCHAR) AS track_name
      FROM events)""")

QUERIES["request_grid"] = q(["listens"], """
SELECT u.username, e.entity, r.time_range
FROM (SELECT DISTINCT username FROM listens) u,
     (VALUES ('artists'), ('releases'), ('recordings')) e(entity),
     (VALUES ('month'), ('year'), ('all_time')) r(time_range)""")

QUERIES["dq_not_null"] = q(["files"], "SELECT filepath FROM files WHERE album_artist_mbid IS NULL")

QUERIES["dq_orphans"] = q(["files", "name_map", "artists"], """
, fa AS (
  SELECT f.filepath, UNNEST(m.artist_mbids) AS artist_mbid FROM files f JOIN name_map m USING (recording_md5)
  WHERE len(m.artist_mbids) > 0
  UNION SELECT filepath, artist_mbid FROM files WHERE artist_mbid IS NOT NULL
  UNION SELECT filepath, album_artist_mbid FROM files WHERE album_artist_mbid IS NOT NULL)
SELECT * FROM fa WHERE artist_mbid NOT IN (SELECT artist_mbid FROM artists)""")


QUERIES["stream_spike_counts"] = q(["listens"], _STARTS + """
SELECT start_listen_md5 AS listen_md5, username, recording_mbid, period_start_at_utc AS listen_at_ts_utc, next_24h_listen_count,
       period_start_at_utc + INTERVAL 1 DAY <= (SELECT max(listen_at_ts_utc) - INTERVAL 1 HOUR FROM listens) AS is_closed
FROM starts""")


QUERIES["playlist_xspf"] = q(["files", "cf_sym", "playlist_seeds"],
    KNN_BODY.format(min_distance=0.5, cw_table=NO_CW, limit=2000).replace(
        "SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position", ", top AS (SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position", 1)
    + """)
SELECT playlist_id,
       '<?xml version="1.0" encoding="UTF-8"?><playlist version="1" xmlns="http://xspf.org/ns/0/">'
       || '<creator>cadence</creator><annotation>Songs like ' || playlist_id || '</annotation><trackList>'
       || string_agg('<track><location>' || replace(replace(replace(filepath, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
                     || '</location>'
                     || CASE WHEN track_length_seconds IS NOT NULL AND track_length_seconds <> 0
                             THEN '<duration>' || CAST(track_length_seconds * 1000 AS VARCHAR) || '</duration>' ELSE '' END
                     || '</track>', '' ORDER BY position)
       || '</trackList></playlist>' AS xspf
FROM top GROUP BY playlist_id""")


# --- greedy playlist composition (recursive walk over the ranked candidates) ----------

_SPECIAL = ", ".join("'" + x + "'" for x in [
    "f731ccc4-e22a-43af-a747-64213329e088", "33cf029c-63b0-41a0-9855-be2a3665fb3b",
    "314e1c25-dde7-4e4d-b2f4-0a7b9f7c56dc", "eec63d3c-3b81-4ad4-b1e4-7c147d4d2b61",
    "9be7f096-97ec-4615-8957-8d40b5dcbc41", "125ec42a-7229-4250-afc5-e057484327fe",
    "89ad4ac3-39f7-470e-963a-56509c546377"])

_PG = q(
    ["listens", "files", "map_file_recording", "cf_sym"],
    FILE_COUNTS_CTE + """
, seeds_raw AS (""" + ADAPTERS["playlist_seeds"] + """)
, playlist_seeds AS (
  SELECT s.playlist_id, s.username, s.filepath, ln(2 + greatest(coalesce(fc.lifetime_listen_count, 0), 0)) AS weight
  FROM seeds_raw s LEFT JOIN fc ON fc.username = s.username AND fc.filepath = s.filepath)
, recent AS (
  SELECT username, filepath, recency_score FROM fc WHERE last30_listen_count > 0 AND recency_score IS NOT NULL)
, cw AS (
  SELECT o.playlist_id, r.filepath, 1.0 / (1.0 + r.recency_score * 0.5) AS weight
  FROM (SELECT DISTINCT playlist_id, username FROM playlist_seeds) o JOIN recent r USING (username))"""
    + KNN_BODY.format(min_distance=0.5, cw_table="cw", limit=1000000000).replace(
        "SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position",
        ", top AS (SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position", 1)
    + f""")
, gc AS (
  SELECT t.*, s.filepath IS NOT NULL AS is_seed_path
  FROM top t LEFT JOIN seeds_raw s ON s.playlist_id = t.playlist_id AND s.filepath = t.filepath)
, g(playlist_id, pos, n_acc, acc, ok) AS (
  SELECT playlist_id, 0, 0, []::VARCHAR[], false FROM (SELECT DISTINCT playlist_id FROM gc)
  UNION ALL
  SELECT playlist_id, pos, n_acc + CASE WHEN ok THEN 1 ELSE 0 END,
         CASE WHEN ok THEN list_concat(acc, mem) ELSE acc END, ok
  FROM (
    SELECT g.playlist_id, c.position AS pos, g.n_acc, g.acc,
           (NOT c.is_seed_path AND c.artist_mbid IS NOT NULL AND c.album_artist_mbid IS NOT NULL
            AND len(list_filter(g.acc, lambda x: x = c.artist_mbid)) < 2
            AND len(list_filter(g.acc, lambda x: x = c.album_artist_mbid)) < 2) AS ok,
           list_filter(list_distinct([c.artist_mbid, c.album_artist_mbid]), lambda x: x NOT IN ({_SPECIAL})) AS mem
    FROM g JOIN gc c ON c.playlist_id = g.playlist_id AND c.position = g.pos + 1
    WHERE g.n_acc < 19))
, rest AS (
  SELECT c.*, row_number() OVER (PARTITION BY c.playlist_id ORDER BY c.position) AS r
  FROM gc c JOIN g ON g.playlist_id = c.playlist_id AND g.pos = c.position AND g.ok)
, chosen AS (
  SELECT playlist_id, filepath FROM (
    SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY md5(playlist_id || filepath), filepath) AS rn
    FROM seeds_raw) WHERE rn = 1)
SELECT c.playlist_id, c.filepath, f.recording_mbid, f.release_mbid, f.release_group_mbid, f.artist_mbid,
       coalesce(f.album_artist_mbid, f.artist_mbid) AS album_artist_mbid,
       CAST(floor(f.track_length_seconds) AS INTEGER) AS track_length_seconds,
       0.0::DOUBLE AS match_distance, true AS is_seed, 0 AS order_index
FROM chosen c JOIN files f USING (filepath)
UNION ALL
SELECT playlist_id, filepath, recording_mbid, release_mbid, release_group_mbid, artist_mbid, album_artist_mbid,
       track_length_seconds, distance AS match_distance, false AS is_seed, CAST(r AS INTEGER) AS order_index
FROM rest""")
QUERIES["playlist_greedy"] = _PG.replace("WITH ", "WITH RECURSIVE ", 1)


_CT = "WITH RECURSIVE rt AS (" + QUERIES["revisit_tracks"] + """)
, top AS (
  SELECT rt.username, rt.filepath, rt.recording_mbid, rt.artist_mbid,
         coalesce(rt.album_artist_mbid, '<null>') AS aa, rt.album_artist_mbid,
         CAST(floor(CAST(30 + f.vec_id % 300 AS DOUBLE) + 0.5) AS INTEGER) AS track_length_seconds,
         row_number() OVER (PARTITION BY rt.username ORDER BY rt.revisit_score DESC, rt.recording_mbid) AS pos
  FROM rt JOIN (SELECT 'lib/' || CAST(label AS VARCHAR) || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.flac' AS filepath,
                       vec_id FROM embeddings) f USING (filepath))
, g(username, pos, n_acc, recs, paths, arts, ok) AS (
  SELECT username, 0, 0, []::VARCHAR[], []::VARCHAR[], []::VARCHAR[], false FROM (SELECT DISTINCT username FROM top)
  UNION ALL
  SELECT username, pos, n_acc + CASE WHEN ok THEN 1 ELSE 0 END,
         CASE WHEN ok THEN list_append(recs, rec) ELSE recs END,
         CASE WHEN ok THEN list_append(paths, fp) ELSE paths END,
         CASE WHEN ok THEN (CASE WHEN aa <> a THEN list_concat(arts, [a, aa]) ELSE list_append(arts, a) END) ELSE arts END,
         ok
  FROM (
    SELECT g.username, t.pos, g.n_acc, g.recs, g.paths, g.arts, t.recording_mbid AS rec, t.filepath AS fp,
           t.artist_mbid AS a, t.aa,
           (NOT list_contains(g.recs, t.recording_mbid) AND NOT list_contains(g.paths, t.filepath)
            AND len(list_filter(g.arts, lambda x: x = t.artist_mbid)) < 2
            AND len(list_filter(g.arts, lambda x: x = t.aa)) < 2) AS ok
    FROM g JOIN top t ON t.username = g.username AND t.pos = g.pos + 1
    WHERE g.n_acc < 20))
SELECT t.username,
       CAST(row_number() OVER (PARTITION BY t.username ORDER BY md5('0|' || t.username || '|' || t.filepath), t.filepath) - 1
            AS INTEGER) AS order_index,
       t.filepath, t.recording_mbid, t.artist_mbid, t.album_artist_mbid, t.track_length_seconds
FROM top t JOIN g ON g.username = t.username AND g.pos = t.pos AND g.ok"""
QUERIES["cull_tracks"] = _CT


def _greedy_with_seeds(seeds_raw_sql: str, extra: str, names: list[str]) -> str:
    """The greedy playlist SQL with another seed source (playlist_id, username, filepath)."""
    body = _PG[_PG.index("\n, lfm AS ("):]
    start = body.index(", seeds_raw AS (")
    end = body.index(", playlist_seeds AS (")
    body = body[:start] + ", seeds_raw AS (" + seeds_raw_sql + ")\n" + body[end:]
    return q(names, extra + body).replace("WITH ", "WITH RECURSIVE ", 1)


_TOP_ARTIST_SOURCES = """
, ta_counts AS (
  SELECT b.username, b.artist_mbid, max(d.artist_name) AS artist_name, count(*) AS lifetime_listen_count
  FROM base_a b JOIN artists d ON b.artist_mbid = d.artist_mbid GROUP BY 1, 2)
, ta AS (
  SELECT * FROM (
    SELECT ta_counts.*, row_number() OVER (PARTITION BY username
             ORDER BY md5('0|' || username || '|' || artist_mbid), username, artist_mbid) AS rn
    FROM ta_counts WHERE lifetime_listen_count >= 50) WHERE rn <= 15)
, requests AS (SELECT username || ':' || artist_mbid AS playlist_id, username, artist_mbid AS mbid, artist_name FROM ta)
, universe AS (
  SELECT DISTINCT mbid, entity FROM (
    SELECT release_mbid AS mbid, 'release' AS entity FROM listens
    UNION ALL SELECT release_mbid, 'release' FROM files
    UNION ALL SELECT release_mbid, 'release' FROM name_map
    UNION ALL SELECT mbid, 'release' FROM sua WHERE entity = 'release'
    UNION ALL SELECT release_group_mbid, 'release-group' FROM files
    UNION ALL SELECT release_group_mbid, 'release-group' FROM name_map
    UNION ALL SELECT release_group_mbid, 'release-group' FROM releases
    UNION ALL SELECT recording_mbid, 'recording' FROM listens
    UNION ALL SELECT recording_mbid, 'recording' FROM name_map
    UNION ALL SELECT recording_mbid, 'recording' FROM files
    UNION ALL SELECT mbid, 'recording' FROM sua WHERE entity = 'recording'
    UNION ALL SELECT recording_mbid, 'recording' FROM feedback
    UNION ALL SELECT UNNEST(artist_mbids), 'artist' FROM listens
    UNION ALL SELECT artist_mbid, 'artist' FROM files
    UNION ALL SELECT album_artist_mbid, 'artist' FROM files
    UNION ALL SELECT UNNEST(artist_mbids), 'artist' FROM name_map
    UNION ALL SELECT mbid, 'artist' FROM sua WHERE entity = 'artist')
  WHERE mbid IS NOT NULL)
, fml AS (""" + QUERIES["file_maps"][QUERIES["file_maps"].index("\nSELECT 'recording' AS entity"):] + """)
, routed AS (
  SELECT DISTINCT r.playlist_id, r.username, m.filepath
  FROM requests r JOIN universe u USING (mbid) JOIN fml m ON m.entity = u.entity AND m.mbid = r.mbid)
, sources AS (
  SELECT playlist_id, username, filepath FROM routed)"""

_TA = _greedy_with_seeds(
    "SELECT playlist_id, username, filepath FROM sources",
    recency_base(LISTEN_AS_OF).replace(", base AS (", ", rbase AS (")
    + _ART_SRC.replace("FROM base b", "FROM rbase b") + SIMILAR_CTE + _TOP_ARTIST_SOURCES,
    ["listens", "files", "map_file_recording", "cf_sym", "releases", "artists", "name_map", "feedback"])
_TA_FINAL = _TA[:_TA.rindex("SELECT c.playlist_id, c.filepath")]
QUERIES["top_artists_playlists"] = _TA_FINAL + """
, composed AS (
SELECT c.playlist_id, c.filepath, f.recording_mbid, f.release_mbid, f.release_group_mbid, f.artist_mbid,
       coalesce(f.album_artist_mbid, f.artist_mbid) AS album_artist_mbid,
       CAST(floor(f.track_length_seconds) AS INTEGER) AS track_length_seconds,
       0.0::DOUBLE AS match_distance, true AS is_seed, 0 AS order_index
FROM chosen c JOIN files f USING (filepath)
UNION ALL
SELECT playlist_id, filepath, recording_mbid, release_mbid, release_group_mbid, artist_mbid, album_artist_mbid,
       track_length_seconds, distance AS match_distance, false AS is_seed, CAST(r AS INTEGER) AS order_index
FROM rest)
SELECT composed.*, 'Songs like ' || requests.artist_name AS description
FROM composed JOIN requests USING (playlist_id)"""


QUERIES["playlist_json"] = q(["files", "cf_sym", "playlist_seeds"],
    KNN_BODY.format(min_distance=0.5, cw_table=NO_CW, limit=2000).replace(
        "SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position", ", top AS (SELECT k.playlist_id, CAST(k.position AS INTEGER) AS position", 1)
    + """)
SELECT playlist_id,
       CAST(json_object(
         'playlist', list(json_object('filepath', filepath, 'recording_mbid', recording_mbid, 'release_mbid', release_mbid,
                                      'release_group_mbid', release_group_mbid, 'artist_mbid', artist_mbid,
                                      'album_artist_mbid', album_artist_mbid, 'track_length_seconds', track_length_seconds,
                                      'match_distance', distance) ORDER BY position),
         'description', 'Songs like ' || playlist_id) AS VARCHAR) AS json
FROM top GROUP BY playlist_id""")


QUERIES["queue_log_gate"] = q([], """
, logs AS (
  SELECT ['new', 'http_fail', 'updated'][o_orderkey % 3 + 1] AS source,
         o_orderdate + to_seconds(CAST(o_orderkey % 900 AS BIGINT)) AS as_of_ts_utc
  FROM orders)
, last AS (SELECT source, max(as_of_ts_utc) AS last_log_at FROM logs GROUP BY 1)
SELECT s.source, l.last_log_at,
       (l.last_log_at IS NULL OR l.last_log_at < TIMESTAMP '2001-08-01 00:05:00' - INTERVAL 300 SECOND) AS due
FROM (VALUES ('new'), ('http_fail'), ('updated'), ('old')) s(source) LEFT JOIN last l USING (source)""")


# --- stored playlists, feedback, tags, growing similarity ---------------------------------

QUERIES["feedback_scan"] = q([], f"""
SELECT md5(username || '-1-' || recording_mbid) AS feedback_md5, username, 1 AS score, recording_mbid,
       make_timestamp(max(sec) * 1000000) AS feedback_at, TIMESTAMP '2024-02-01' AS _ingest_insert_ts_utc
FROM (SELECT 'u' || CAST(user_id % 10 AS VARCHAR) AS username, {mbid('r', 'event_id % 3000')} AS recording_mbid,
             CAST(floor(epoch(ts)) AS BIGINT) AS sec
      FROM events WHERE event_type = 'purchase' AND event_id % 11 <> 0)
GROUP BY username, recording_mbid""")

QUERIES["tag_aliases"] = q([], """
SELECT 'lib/' || label || '/' || lpad(CAST(vec_id AS VARCHAR), 6, '0') || '.flac' AS filepath, 'Track ' || vec_id AS title,
       'Album' AS album, CASE WHEN vec_id % 7 <> 0 THEN 'Artist ' || label END AS artist,
       CASE vec_id % 3 WHEN 0 THEN 'Artist ' || (vec_id % 13) WHEN 1 THEN 'Artist ' || (vec_id % 13) || '*' END AS album_artist,
       (1990 + vec_id % 30) || CASE WHEN vec_id % 5 = 0 THEN '-05-01' ELSE '' END AS date, CAST(NULL AS VARCHAR) AS genre
FROM embeddings""")

QUERIES["dump_timestamps"] = q([], f"""
SELECT o_orderkey || '-' || {ent('o_orderkey')} AS slug, CAST(o_orderkey AS BIGINT) AS packet_number, {ent('o_orderkey')} AS entity,
       CASE WHEN o_orderkey % 17 <> 0 AND o_orderkey % 19 <> 0
            THEN date_trunc('second', CAST(o_orderdate AS TIMESTAMP)) + to_microseconds(CAST(o_orderkey % 1000000 AS BIGINT)) END AS dump_timestamp
FROM orders""")

ADAPTERS["stored_tracks"] = """
SELECT filepath, 'pl' || n AS playlist_id, n, n % 4 AS c, ['top-artists', 'smart-mix', 'loved-tracks', 'revisit-tracks'][n % 4 + 1] AS collection_name,
       'u' || (n % 4 % 2) AS username, artist_mbid,
       CAST(row_number() OVER (PARTITION BY n ORDER BY filepath) - 1 AS INTEGER) AS track_order_index
FROM (SELECT filepath, artist_mbid, unnest([CAST(vec_id % 7 AS INTEGER), CAST((vec_id + 4) % 7 + 7 AS INTEGER)]) AS n FROM files)"""

QUERIES["playlist_views"] = q(["files", "stored_tracks"], f"""
SELECT {mbid('t', "playlist_id || '/' || filepath")} AS track_id, {mbid('p', 'n')} AS playlist_id, {mbid('c', 'c')} AS collection_id,
       track_order_index, filepath, artist_mbid, track_order_index = 0 AS is_seed, n // 4 AS collection_order_index,
       collection_name || ' ' || n AS title, collection_name, username
FROM stored_tracks""")

QUERIES["playlist_replace"] = q(["files", "stored_tracks"], """
SELECT username, collection_name, playlist_id || CASE WHEN old THEN '' ELSE '/new' END AS playlist_id,
       CASE WHEN old THEN track_order_index ELSE track_order_index // 3 END AS track_order_index, filepath,
       CASE WHEN old THEN TIMESTAMP '2024-05-18 10:00:00' ELSE TIMESTAMP '2024-05-18 12:00:00' END AS refreshed_at_utc
FROM (SELECT *, collection_name = 'smart-mix' AS old FROM stored_tracks)
WHERE old OR track_order_index % 3 = 0""")

QUERIES["playlist_sync"] = q(["files", "stored_tracks"], """
, here AS (SELECT DISTINCT collection_name, playlist_id FROM stored_tracks)
, there AS (SELECT * FROM here WHERE playlist_id <> 'pl13' UNION SELECT collection_name, 'pl99' FROM here WHERE collection_name = 'loved-tracks')
SELECT coalesce(h.collection_name, t.collection_name) AS collection_name, CAST(count(h.playlist_id) AS BIGINT) AS n_stored,
       CAST(count(t.playlist_id) AS BIGINT) AS n_server, count(*) FILTER (h.playlist_id = t.playlist_id) AS n_both,
       bool_and(h.playlist_id IS NOT DISTINCT FROM t.playlist_id) AS in_sync
FROM here h FULL JOIN there t USING (collection_name, playlist_id) GROUP BY 1""".replace("h.playlist_id = t.playlist_id", "h.playlist_id IS NOT NULL AND t.playlist_id IS NOT NULL"))

QUERIES["loves_diff_starred"] = q(["listens", "feedback", "files", "map_file_recording"], SPIKES_GLOBAL + """
, loved AS (
  SELECT DISTINCT l.username, m.filepath FROM (
    SELECT username, recording_mbid FROM feedback UNION SELECT username, recording_mbid FROM spikes) l
  JOIN map_file_recording m USING (recording_mbid))
, stars AS (SELECT DISTINCT 'u' || unnest([vec_id % 20, (vec_id * 7 + 3) % 20]) AS username, filepath FROM files)
(SELECT username, filepath, 'to_star' AS direction FROM (SELECT * FROM loved EXCEPT SELECT * FROM stars))
UNION ALL (SELECT username, filepath, 'to_submit' FROM (SELECT * FROM stars EXCEPT SELECT * FROM loved))""")

ADAPTERS["cf_pair_half"] = f"""
SELECT least({mbid('s', 'x')}, {mbid('s', 'y')}) AS artist_mbid_a, greatest({mbid('s', 'x')}, {mbid('s', 'y')}) AS artist_mbid_b, score_value
FROM (SELECT least(x, y) AS x, greatest(x, y) AS y, count(*) / (count(*) + 2.0::DOUBLE) AS score_value
      FROM (SELECT l_suppkey AS x, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS y FROM lineitem)
      WHERE x <> y GROUP BY 1, 2
      UNION ALL SELECT DISTINCT l_suppkey, l_suppkey, 1.0::DOUBLE FROM lineitem)"""
ADAPTERS["cf_pair_sym"] = """
SELECT * FROM cf_pair_half
UNION ALL SELECT artist_mbid_b, artist_mbid_a, score_value FROM cf_pair_half WHERE artist_mbid_a <> artist_mbid_b"""

QUERIES["cf_symmetrise_pairs"] = q(["cf_pair_half", "cf_pair_sym"], "SELECT artist_mbid_a, artist_mbid_b, round(score_value, 6) AS score_value FROM cf_pair_sym")

QUERIES["cf_baseline_pairs"] = q(["cf_pair_half", "cf_pair_sym"], """
, per AS (
  SELECT artist_mbid_a, min(e) AS lo, median(e) AS mid, avg(e) AS mean, max(e) AS hi, count(*) AS n
  FROM (SELECT artist_mbid_a, exp(score_value) AS e FROM cf_pair_sym) GROUP BY 1)
, q AS (SELECT quantile_cont(mid, [0.25, 0.5, 0.75]) AS m FROM per)
SELECT artist_mbid_a, round(lo, 6) AS min_score, round(mid, 6) AS median_score, round(mean, 6) AS avg_score, round(hi, 6) AS max_score, n,
       round(m[1], 6) AS median_q1, round(m[2], 6) AS median_q2, round(m[3], 6) AS median_q3, round(ln(m[2]), 6) AS baseline
FROM per, q""")

QUERIES["cf_calibration_pairs"] = q(["cf_pair_half", "cf_pair_sym"], """
, base AS (SELECT ln(median(m)) AS b FROM (SELECT median(exp(score_value)) AS m FROM cf_pair_sym GROUP BY artist_mbid_a))
, span AS (SELECT min(score_value) AS lo, max(score_value) AS hi FROM cf_pair_sym)
, curve AS (SELECT lo + unnest(range(0, CAST(ceil((hi - lo) / 0.01) AS BIGINT))) * 0.01 AS x FROM span)
SELECT round(x, 6) AS similarity, round(s, 6) AS scalar, round(exp(s * (x - b)), 6) AS multiplier
FROM curve, base, (SELECT unnest([0.5, 0.75, 1.0, 1.25, 1.5, 1.75, 2.0])::DOUBLE AS s)""")


# --- exact parts and laws of the models ------------------------------------------------------

_MIX_TRACKS = SPIKES_GLOBAL + FILE_COUNTS_CTE + """
, picked AS (
  SELECT username, filepath FROM fc WHERE lifetime_listen_count > 2
  UNION SELECT l.username, m.filepath FROM (SELECT username, recording_mbid FROM feedback UNION SELECT username, recording_mbid FROM spikes) l
        JOIN map_file_recording m USING (recording_mbid))
, mix AS (
  SELECT username, filepath, track_name, coalesce(album_artist_name, artist_name) AS artist_name,
         coalesce(album_artist_mbid, artist_mbid) AS artist_mbid, embedding
  FROM picked JOIN files USING (filepath)
  WHERE embedding_success AND embedding_duration_seconds > 60 AND artist_mbid IS NOT NULL)"""
_MIX_NAMES = ["listens", "feedback", "files", "map_file_recording", "cf_sym"]
_MIX_DISTANCES = _MIX_TRACKS + """
, unlike AS (
  SELECT a.username, a.filepath, b.filepath AS other,
         (1 - list_cosine_similarity(a.embedding, b.embedding))
         / CASE WHEN a.artist_mbid = b.artist_mbid THEN exp((1 - 0.363023320190634) * 0.5)
                ELSE coalesce(exp((c.score_value - 0.363023320190634) * 0.5), 1) END AS d
  FROM mix a JOIN mix b ON a.username = b.username AND a.filepath <> b.filepath
  LEFT JOIN cf_sym c ON c.artist_mbid_a = a.artist_mbid AND c.artist_mbid_b = b.artist_mbid)"""

QUERIES["clusterable_tracks"] = q(_MIX_NAMES, _MIX_TRACKS + "\nSELECT username, filepath, track_name, artist_name, artist_mbid FROM mix")
QUERIES["track_core_distances"] = q(_MIX_NAMES, _MIX_DISTANCES + """
SELECT username, filepath, round(list_sort(min(d, 2))[2], 6) AS core FROM unlike GROUP BY 1, 2""")
QUERIES["cluster_mean_distances"] = q(_MIX_NAMES, _MIX_DISTANCES + """
, named AS (SELECT *, CAST(substr(filepath, -7, 2) AS INTEGER) % 9 AS label, CAST(substr(other, -7, 2) AS INTEGER) % 9 AS theirs FROM unlike)
SELECT username, label, round(avg(d), 6) AS mean_distance FROM named WHERE label = theirs GROUP BY 1, 2""")
QUERIES["item_top_similar"] = q([], """
, v AS (SELECT lpad(CAST(vec_id AS VARCHAR), 9, '0') AS id, CAST(embedding AS DOUBLE[]) AS e, vec_id FROM embeddings)
, s AS (SELECT a.id AS artist_mbid_a, b.id AS artist_mbid_b, round(list_cosine_similarity(a.e, b.e), 12) AS score
        FROM v a JOIN v b ON a.id <> b.id WHERE a.vec_id % 100 = 0)
SELECT artist_mbid_a, artist_mbid_b, round(score, 6) AS score_value,
       CAST(row_number() OVER (PARTITION BY artist_mbid_a ORDER BY score DESC, artist_mbid_b) AS INTEGER) AS rank
FROM s QUALIFY rank <= 20""")
QUERIES["item_similarity_laws"] = q(["dump_records"], DUMP_AGG_CTE + """
, n AS (SELECT count(DISTINCT artist_mbid) AS n FROM agg)
SELECT CAST(n * (n + 1) // 2 AS BIGINT) AS n_pairs, n AS n_artists, n AS n_ones, CAST(0 AS BIGINT) AS n_disordered, CAST(0 AS BIGINT) AS n_no_cosine FROM n""")
QUERIES["conditioner_registry"] = q(["files"], """
SELECT count(*) AS n_files, count(*) FILTER (embedding_success) AS n_scored, 50 AS dims, true AS centred, true AS variance_falls,
       true AS orthonormal, true AS unknown_refused FROM files""")
