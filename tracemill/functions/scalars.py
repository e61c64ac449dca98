"""Scalar functions, each a Column expression that stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

MAX_IDENTIFIER = 63


def _group(c: Column, pattern: str, k: int) -> Column:
    """Group k of the first match; null where nothing matched."""
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def sanitize_identifier(c: Column) -> Column:
    """A column name from any text: letters, digits and single underscores, lower case, at most 63 characters."""
    clean = c.rlike(r"^[a-z][a-z0-9]*(?:_[a-z0-9]+)*$") & (F.length(c) <= MAX_IDENTIFIER)
    s = F.regexp_replace(F.trim(c), r"[^\p{L}\p{N}_]", "_")
    s = F.lower(F.trim(F.regexp_replace(s, "_+", "_"), F.lit("_")))
    s = F.when(s == "", "field").otherwise(s)
    s = F.when(s.rlike(r"^\p{N}"), F.concat(F.lit("field_"), s)).otherwise(s)
    head = F.rtrim(F.substring(s, 1, MAX_IDENTIFIER - 9), F.lit("_"))
    return F.when(clean, c).when(F.length(s) <= MAX_IDENTIFIER, s).otherwise(F.concat(head, F.lit("_"), F.substring(F.md5(s), 1, 8)))


def unique_names(names: list[str]) -> list[str]:
    """Distinct names for a header: the second x is x_2, the third x_3, within 63 characters."""
    taken: list[str] = []
    for name in names:
        k, free = 2, name
        while free in taken:
            end = f"_{k}"
            k, free = k + 1, name[: MAX_IDENTIFIER - len(end)].rstrip("_") + end
        taken.append(free)
    return taken


def file_stem(c: Column) -> Column:
    """The file name without folders and its last extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def logical_name(c: Column) -> Column:
    return sanitize_identifier(file_stem(c))


def display_name(filename: Column, parser_key: Column) -> Column:
    """What people read: the stem after an archive's colon, words capitalised, then the parser."""
    stem = F.replace(F.element_at(F.split(file_stem(filename), ":"), -1), F.lit("_"), F.lit(" "))
    return F.initcap(F.trim(F.concat(stem, F.lit(" "), F.replace(parser_key, F.lit("_"), F.lit(" ")))))


def stable_hash(c: Column) -> Column:
    return F.substring(F.md5(c), 1, 12)


def strip_nul(c: Column) -> Column:
    return F.translate(c, "\x00", "")


def size_label(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.concat(F.format_string("%.1f", n / 1024), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1024**2), F.lit(" MB")))


def duration_label(start: Column, end: Column, status: Column) -> Column:
    seconds = F.round((F.unix_millis(end.cast("timestamp")) - F.unix_millis(start.cast("timestamp"))) / 1000).cast("long")
    return F.when(status.isin("queued", "processing"), "In progress").otherwise(F.concat(seconds.cast("string"), F.lit("s")))


# -- timestamps ------------------------------------------------------------


def iso_timestamp(c: Column) -> Column:
    """ISO text with its offset kept; Z and none become +00:00; null if it is no timestamp.

    Works on the text, so the offset that was written survives.
    """
    t = F.replace(F.trim(c), F.lit(" "), F.lit("T"))
    shape = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2}:\d{2})(\.\d{1,9})?(Z|[+-]\d{2}:?\d{2})?$"
    fraction = F.regexp_extract(t, shape, 3)
    fraction = F.when(F.regexp_like(fraction, F.lit(r"^(?:\.0*)?$")), "").otherwise(F.rpad(F.substring(fraction, 1, 7), 7, "0"))
    offset = F.regexp_extract(t, shape, 4)
    offset = F.when(offset.isin("", "Z"), "+00:00").otherwise(F.regexp_replace(offset, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
    plain = F.concat(F.regexp_extract(t, shape, 1), F.lit(" "), F.regexp_extract(t, shape, 2))
    return F.when(t.rlike(shape) & F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss")).isNotNull(), F.concat(F.regexp_extract(t, shape, 1), F.lit("T"), F.regexp_extract(t, shape, 2), fraction, offset))


def as_timestamp(c: Column) -> Column:
    """A timestamp from text, null if it isn't one; without offset it is in the session's zone (UTC)."""
    return F.try_to_timestamp(c.cast("string"))


def row_timestamp(*columns: Column) -> Column:
    """The first of the columns (timestamp, ts, time) that parses."""
    return F.coalesce(*map(as_timestamp, columns))


def first_timestamp(c: Column) -> Column:
    return _group(c, P.ANY_TIMESTAMP, 1)


# -- levels ------------------------------------------------------------------


def infer_level(c: Column) -> Column:
    """The level a line speaks of, worst first; INFO if none."""
    low = F.lower(c)
    has = lambda *words: low.rlike("|".join(words))
    return F.when(has("critical", "panic"), "CRITICAL").when(has("fatal"), "FATAL").when(has("error"), "ERROR").when(has("warn"), "WARNING").when(has("debug"), "DEBUG").when(has("trace"), "TRACE").otherwise("INFO")


def level_word(c: Column) -> Column:
    return F.upper(_group(c, P.LEVEL_WORD, 1))


def status_level(c: Column) -> Column:
    return F.when(c >= 500, "ERROR").when(c >= 400, "WARNING").otherwise("INFO")


def normalize_level(c: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(up == "WARNING", "WARN").otherwise(up)


def facility(pri: Column) -> Column:
    return F.floor(pri / 8).cast("long")


def severity(pri: Column) -> Column:
    return (pri % 8).cast("long")


def severity_name(code: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, P.SEVERITY)), code.cast("int")), F.lit("INFO"))


# -- values ------------------------------------------------------------------


def value_kind(c: Column) -> Column:
    """The kind that coerce() gives, without its value."""
    t = F.trim(c)
    low = F.lower(t)
    number, real = t.rlike(r"^[+-]?\d+(?:\.\d+)?[|,;:)\]}]*$"), t.rlike(r"^[+-]?\d+\.\d+[|,;:)\]}]*$")
    return F.when(c.isNull() | low.isin(*P.NULL_WORDS), "null").when(t == "", "text").when(low.isin("true", "false"), "boolean").when(low.isin(*P.STATUS_WORDS), "text").when(real, "real").when(number, "integer").otherwise("text")


def coerce(c: Column) -> Column:
    """struct(kind, value): the type a text stands for (null, boolean, integer, real, text) and its normal text.

    Numbers are tested without trailing | , ; : ) ] }. No exponents.
    """
    t = F.trim(c)
    low = F.lower(t)
    bare = F.regexp_replace(t, r"[|,;:)\]}]+$", "")
    stamp = F.when(t.rlike("^" + P.ISO_TIMESTAMP), iso_timestamp(t))
    kind = value_kind(c)
    whole = F.regexp_replace(F.regexp_replace(bare, r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    value = F.when(kind == "null", F.lit(None)).when(kind == "boolean", low).when(low.isin(*P.STATUS_WORDS), F.replace(F.upper(t), F.lit("WARNING"), F.lit("WARN"))).when(kind == "integer", whole).when(kind == "real", bare).otherwise(F.coalesce(stamp, t))
    return F.struct(kind.alias("kind"), value.alias("value"))


#: Ranks of types in a mixed column, the greatest wins.
TYPE_RANK = {"boolean": 1, "integer": 2, "real": 3, "json": 4, "text": 5, "null": 5}
SQL_TYPE = {1: "BOOLEAN", 2: "INTEGER", 3: "REAL", 4: "JSON", 5: "TEXT"}
#: Types of SQL text, of the store and of Spark.
STORE_TYPE = {"BOOLEAN": "boolean", "INTEGER": "integer", "BIGINT": "bigint", "REAL": "float", "NUMERIC": "float", "DECIMAL": "float", "JSON": "json", "TEXT": "text", "VARCHAR": "string", "CHAR": "string", "STRING": "string", "BYTEA": "bytea", "BLOB": "bytea", "BINARY": "bytea", "DATETIME": "datetime", "TIMESTAMP": "datetime", "TIMESTAMPTZ": "datetime", "UUID": "uuid"}
SPARK_TYPE = {"boolean": "boolean", "integer": "bigint", "bigint": "bigint", "float": "double", "json": "string", "text": "string", "string": "string", "bytea": "binary", "datetime": "timestamp", "uuid": "string"}


def type_rank(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, F.lit(r)) for k, r in TYPE_RANK.items()], F.lit(5))


def sql_type(rank: Column) -> Column:
    return F.coalesce(*[F.when(rank == r, F.lit(t)) for r, t in SQL_TYPE.items()], F.lit("TEXT"))


def is_json(c: Column) -> Column:
    """Whether a text is one whole JSON value, with nothing after it."""
    return F.coalesce(F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1, F.lit(False)) & c.rlike(r"[\]}\"\w]\s*$")


def smart_cast(c: Column) -> Column:
    """struct(kind, value) as coerce, but empty is null, exponents are numbers and JSON is told apart."""
    t = F.trim(c)
    low = F.lower(t)
    json = t.rlike(r"^[\[{]") & is_json(t)
    number = t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    kind = F.when(c.isNull() | low.isin("", "null", "none"), "null").when(low.isin("true", "false"), "boolean").when(t.rlike(r"^[+-]?\d+$"), "integer").when(number, "real").when(json, "json").otherwise("text")
    return F.struct(kind.alias("kind"), F.when(kind != "null", F.when(kind == "boolean", low).otherwise(t)).alias("value"))


def export_text(c: Column) -> Column:
    """A cell of an export: null is empty, nested values are JSON."""
    return F.coalesce(c.cast("string"), F.lit(""))


def jaccard(a: Column, b: Column) -> Column:
    """Of the sets of words; two empty texts are equal, one is unlike any other."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def skeleton(c: Column) -> Column:
    """A line with its variable parts replaced."""
    s = F.btrim(c, F.lit(" \t\n\x0b\f\r"))
    for pattern, mark in ((P.UUID, "<UUID>"), (P.IP, "<IP>"), (P.HEX, "<HEX>"), (P.QUOTED, '"<STR>"'), (P.NUM, "<NUM>"), (r"\s+", " ")):
        s = F.regexp_replace(s, pattern, mark)
    return s


def template_id(skeleton_text: Column) -> Column:
    return F.substring(F.sha2(skeleton_text, 256), 1, 12)


def attack(c: Column) -> Column:
    """Which attack pattern a line holds, the first that applies; null if none."""
    low = F.lower(c)
    return F.when(low.rlike(P.SQL_INJECTION), "sql").when(low.rlike(P.SCRIPT_INJECTION), "script").when(low.rlike(P.SHELL_INJECTION), "shell")


def chart_number(c: Column) -> Column:
    """What a chart plots: the number, or 0 where there is none."""
    number = c.cast("string").try_cast("double")
    return F.when(number.isNull() | F.isnan(number), F.lit(0.0)).otherwise(number)


def json_object(c: Column) -> Column:
    """JSON text that is surely an object: another value becomes {"value": ...}, no JSON {"raw": ...}; null stays."""
    t = F.trim(c)
    wrapped = F.when(F.startswith(t, F.lit("{")), t).otherwise(F.concat(F.lit('{"value":'), t, F.lit("}")))
    return F.when(c.isNull() | (c == ""), F.lit(None)).when(is_json(t), wrapped).otherwise(F.to_json(F.struct(c.alias("raw"))))


def message_text(payload: Column, content: Column) -> Column:
    """The text of a chat message: the text parts of its JSON payload, else its content."""
    parts = F.from_json(F.get_json_object(payload, "$.parts"), "array<struct<type:string,text:string>>")
    text = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "")
    return F.coalesce(F.nullif(text, F.lit("")), F.get_json_object(payload, "$.content"), content)
