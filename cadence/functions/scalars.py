"""Scalar Column functions (JVM-side, codegen-friendly; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
UUID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
SURROGATE_NULL = "_dbt_utils_surrogate_key_null_"
CF_BASELINE = 0.363023320190634
CF_SCALAR = 0.5
MICROS_PER_DAY = 86_400_000_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# --- JSON -----------------------------------------------------------------

def json_get(col, path: str) -> Column:
    """Text at a JSON path, trimmed; empty text becomes NULL."""
    return F.nullif(F.trim(F.get_json_object(_c(col), path)), F.lit(""))


def json_sub(col, path: str) -> Column:
    """Sub-document at a JSON path, as JSON text."""
    return F.get_json_object(_c(col), path)


def json_bool(col, path: str, default: bool = True) -> Column:
    """Boolean flag stored as JSON text ('true'/'false'); NULL -> default."""
    return F.coalesce(F.expr(f"try_cast(get_json_object({_sql(col)}, '{path}') as boolean)"), F.lit(default))


def _sql(col) -> str:
    if isinstance(col, str):
        return f"`{col}`"
    raise TypeError("json_bool takes a column name")


# --- identifiers ----------------------------------------------------------

def try_cast_uuid(col) -> Column:
    """Strict: lower-case canonical UUID text, else NULL."""
    c = _c(col)
    return F.when(c.rlike(UUID_PATTERN), c)


def try_uuid(col) -> Column:
    """Lenient UUID parse (the rules of Python's ``uuid.UUID(text)``):
    'urn:' and 'uuid:' removed, surrounding braces stripped, hyphens
    anywhere ignored, any hex case; 32 hex digits -> canonical lower-case
    text, else NULL."""
    s = F.replace(F.replace(_c(col), F.lit("urn:"), F.lit("")), F.lit("uuid:"), F.lit(""))
    s = F.regexp_replace(s, r"^[{}]+|[{}]+$", "")
    hexes = F.lower(F.regexp_replace(s, "-", ""))
    return F.when(hexes.rlike(r"^[0-9a-f]{32}$"), uuid_from_hex(hexes))


def uuid_from_hex(hex32) -> Column:
    """Hyphenate 32 hex chars as 8-4-4-4-12 (one expression over one input,
    so an md5 argument is evaluated once and generated code stays small)."""
    return F.regexp_replace(_c(hex32), r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def extract_year(col) -> Column:
    """Leading 4-digit year of a date-ish text; NULL when not numeric."""
    c = _c(col)
    head = F.substring(c, 1, 4)
    return F.when(head.rlike(r"^[0-9]{4}$"), head.cast("int"))


def surrogate_key(*cols) -> Column:
    """md5 of '-'-joined text casts; NULL parts become a fixed marker."""
    parts = [F.coalesce(_c(c).cast("string"), F.lit(SURROGATE_NULL)) for c in cols]
    return F.md5(F.concat_ws("-", *parts))


def md5_join(*cols) -> Column:
    """md5 of the '-'-joined parts (ids for feedback rows, live recording hash)."""
    return F.md5(F.concat_ws("-", *[_c(c).cast("string") for c in cols]))


def recording_md5(track, artist, release) -> Column:
    """Normalised (lower/trim) surrogate-key variant of the recording hash."""
    return surrogate_key(*[F.lower(F.trim(_c(c))) for c in (track, artist, release)])


def json_string(col) -> Column:
    """JSON text of a string as an ASCII dump writes it: quotes, backslashes
    and control characters escaped, everything beyond ASCII as \\uXXXX (two of
    them beyond U+FFFF)."""
    def one(ch: Column) -> Column:
        cp = F.ascii(ch)
        esc = lambda n: F.format_string("\\u%04x", n)
        high = F.lit(0xD800) + F.floor((cp - 0x10000) / 0x400).cast("int")
        low = F.lit(0xDC00) + F.pmod(cp - 0x10000, F.lit(0x400)).cast("int")
        out = F.when((ch == '"') | (ch == "\\"), F.concat(F.lit("\\"), ch))
        for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            out = out.when(ch == raw, F.lit(short))
        return out.when(cp > 0xFFFF, F.concat(esc(high), esc(low))).when((cp < 0x20) | (cp > 0x7E), esc(cp)).otherwise(ch)

    chars = F.filter(F.split(_c(col), ""), lambda ch: ch != "")
    return F.concat(F.lit('"'), F.array_join(F.transform(chars, one), ""), F.lit('"'))


def json_list_hash(*cols) -> Column:
    """md5 of the JSON text of a flat list of strings and numbers, '["a", 1]'
    (a number is given as ``(column, "num")``)."""
    parts = [
        _c(c[0]).cast("string") if isinstance(c, tuple) and c[1] == "num" else json_string(c)
        for c in cols
    ]
    return F.md5(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")))


# --- time -----------------------------------------------------------------

def micros(col) -> Column:
    """Microseconds since epoch of a (NTZ or LTZ) timestamp; session TZ is UTC."""
    return F.unix_micros(_c(col).cast("timestamp"))


def elapsed_days(as_of, ts) -> Column:
    """Whole days elapsed from ts to as_of, truncated toward zero."""
    a = F.lit(as_of) if not isinstance(as_of, Column) else as_of
    diff = micros(a) - micros(ts)
    return (F.signum(diff) * F.floor(F.abs(diff) / F.lit(MICROS_PER_DAY))).cast("long")


def within_days(ts, as_of, n: int) -> Column:
    """ts >= as_of - n days."""
    return _c(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {int(n)} DAYS")


# --- scoring --------------------------------------------------------------

def recency_pct(days) -> Column:
    return F.exp(F.lit(-0.1) * _c(days))


def inv_recency_pct(days) -> Column:
    return F.lit(1.0) - F.least(F.exp(F.lit(-0.1) * _c(days)), F.exp(F.lit(-0.1)))


def listen_weight(count) -> Column:
    """ln(2 + max(n, 0)): seed weight from a listen count."""
    return F.log(F.lit(2.0) + F.greatest(F.coalesce(_c(count).cast("double"), F.lit(0.0)), F.lit(0.0)))


def recency_weight(score, fac: float) -> Column:
    """1 / (1 + recency * fac): candidate penalty for recently played tracks."""
    return F.lit(1.0) / (F.lit(1.0) + _c(score) * F.lit(float(fac)))


def cf_multiplier(score) -> Column:
    """exp((s - baseline) * scalar); 1 when no score."""
    return F.coalesce(F.exp((_c(score) - F.lit(CF_BASELINE)) * F.lit(CF_SCALAR)), F.lit(1.0))


def l2_distance(a, b) -> Column:
    """Euclidean distance of two equal-length arrays, computed in double."""
    sq = F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda acc, v: acc + v))


def cosine_distance(a, b) -> Column:
    """1 - cosine similarity of two arrays (double)."""
    dot = F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na = F.sqrt(F.aggregate(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v))
    nb = F.sqrt(F.aggregate(F.transform(_c(b), lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, v: s + v))
    return F.lit(1.0) - dot / (na * nb)


# --- text / misc ----------------------------------------------------------

def parse_bool_text(col) -> Column:
    """'1'/'true' (any case) -> true, else false."""
    return F.lower(F.trim(_c(col))).isin("1", "true")


def path_relative(col, root: str) -> Column:
    """Strip a root folder prefix from a path (unchanged when absent)."""
    root = root.rstrip("/") + "/"
    c = _c(col)
    return F.when(c.startswith(root), F.substring(c, len(root) + 1, 1 << 30)).otherwise(c)


def path_absolute(col, root: str) -> Column:
    return F.concat(F.lit(root.rstrip("/") + "/"), _c(col))


def timeline(min_year, max_year) -> Column:
    """'1999-2010', '2000-2000' for a single year, NULL without years."""
    return F.concat(_c(min_year).cast("string"), F.lit("-"), _c(max_year).cast("string"))


def url_safe_b64_json(struct_col) -> Column:
    """Signature payload: url-safe base64 of the JSON of a struct, on one
    line (Spark's base64 wraps at 76 characters)."""
    b64 = F.regexp_replace(F.base64(F.encode(F.to_json(struct_col), "UTF-8")), r"[\r\n]", "")
    return F.translate(b64, "+/", "-_")


def parse_url_safe_b64_json(col, schema: str, prefix: str) -> Column:
    """Inverse of url_safe_b64_json after a fixed prefix; NULL on garbage."""
    body = F.regexp_extract(_c(col), prefix + r"([A-Za-z0-9_\-=]+)", 1)
    std = F.translate(body, "-_", "+/")
    raw = F.try_to_binary(std, F.lit("base64"))
    return F.when(body != "", F.from_json(F.decode(raw, "UTF-8"), schema))
