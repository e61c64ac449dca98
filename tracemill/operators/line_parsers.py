"""Parsers of line formats, without Python in the data path.

Each takes lines (file_id, filename, line_no, line) and gives one row for each
line it can read; rejected() gives the others with a reason.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions import patterns as P
from ..functions import scalars as S
from ..sources.shared import written

RAW_CHARS, MESSAGE_CHARS = 4000, 500
#: Of a unit of many lines, so many characters are gathered.
UNIT_CHARS = 20_000
_KEYS = ("file_id", "filename", "line_no")


#: What \s of an expression matches.
_SPACE = " \t\n\x0b\f\r"
#: Numbers of lines that are windowed in one task; a longer file is cut by them.
PART_LINES = 4096


def _bare(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.btrim("line", F.lit(_SPACE)))


def _stripped(lines: DataFrame) -> DataFrame:
    return _bare(lines).where("line != ''")


# -- windows over a file, in two steps so that a long file is no single task ----


def _parted(lines: DataFrame) -> DataFrame:
    return lines.withColumn("part", F.floor((F.col("line_no") - 1) / PART_LINES))


def _inside() -> WindowSpec:
    return Window.partitionBy("file_id", "part").orderBy("line_no")


def _parts_before() -> WindowSpec:
    return Window.partitionBy("file_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)


def _with_before(d: DataFrame, value: str, name: str) -> DataFrame:
    """Parted lines with name: value of the file's line before, null for the first. value is never null."""
    ends = d.groupBy("file_id", "part").agg(F.max_by(value, "line_no").alias("end"))
    ends = ends.select("file_id", "part", F.lag("end").over(Window.partitionBy("file_id").orderBy("part")).alias("carried"))
    d = d.withColumn(name, F.lag(value).over(_inside())).join(ends, ["file_id", "part"])
    return d.withColumn(name, F.coalesce(name, "carried")).drop("carried")


def _with_last(d: DataFrame, value: str, name: str) -> DataFrame:
    """Parted lines with name: the last value so far in the file that isn't null."""
    ends = d.groupBy("file_id", "part").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col("line_no"))).alias("end"))
    ends = ends.select("file_id", "part", F.last("end", ignorenulls=True).over(_parts_before()).alias("carried"))
    d = d.withColumn(name, F.last(value, ignorenulls=True).over(_inside())).join(ends, ["file_id", "part"])
    return d.withColumn(name, F.coalesce(name, "carried")).drop("carried")


def _with_running(d: DataFrame, value: str, name: str) -> DataFrame:
    """Parted lines with name: the sum of value so far in the file, this line's included."""
    sums = d.groupBy("file_id", "part").agg(F.sum(value).alias("held"))
    sums = sums.select("file_id", "part", F.coalesce(F.sum("held").over(_parts_before()), F.lit(0)).alias("base"))
    d = d.withColumn(name, F.sum(value).over(_inside())).join(sums, ["file_id", "part"])
    return d.withColumn(name, F.col("base") + F.col(name)).drop("base")


def numbered_rows(lines: DataFrame) -> DataFrame:
    """Lines with row_no, their place among the file's given lines from 1."""
    d = _with_running(_parted(lines).withColumn("one", F.lit(1).cast("long")), "one", "row_no")
    return d.drop("one", "part")


def _tail(message: Column) -> list[Column]:
    return [F.substring("line", 1, RAW_CHARS).alias("raw"), F.substring(message, 1, MESSAGE_CHARS).alias("message")]


def syslog(lines: DataFrame) -> DataFrame:
    """timestamp, host, process, pid, message, level (of the message's words), pri and its parts."""
    g = lambda k: S._group(F.col("line"), P.SYSLOG, k)
    d = _stripped(lines).where(F.col("line").rlike(P.SYSLOG))
    message = F.regexp_extract("line", P.SYSLOG, 6)
    level = S.infer_level(F.when(message == "", F.col("line")).otherwise(message))
    pri = g(1).cast("long")
    return d.select(*_KEYS, g(2).alias("timestamp"), g(3).alias("host"), g(4).alias("process"), g(5).cast("long").alias("pid"), *_tail(message), level.alias("log_level"), pri.alias("syslog_pri"), S.facility(pri).alias("syslog_facility"), S.severity(pri).alias("syslog_severity"))


def syslog_events(lines: DataFrame) -> DataFrame:
    """The other reading of syslog: the level is the severity's name, EVENT_NAME: k=v becomes event_type and fields."""
    g = lambda k: S._group(F.col("line"), P.SYSLOG, k)
    d = _stripped(lines).where(F.col("line").rlike(P.SYSLOG)).withColumn("msg", F.trim(F.regexp_extract("line", P.SYSLOG, 6)))
    pri = g(1).cast("long")
    event = S._group(F.col("msg"), P.EVENT_NAME, 1)
    body = F.when(event.isNotNull(), F.regexp_extract("msg", P.EVENT_NAME, 2)).otherwise(F.col("msg"))
    return d.select(*_KEYS, g(2).alias("timestamp"), g(3).alias("hostname"), g(4).alias("process"), g(5).cast("long").alias("pid"), F.when(pri.isNotNull(), S.severity_name(S.severity(pri))).alias("log_level"), F.substring("msg", 1, MESSAGE_CHARS).alias("message"), event.alias("event_type"), pairs(body, P.KEY_VALUE_PAIR).alias("fields"))


def access(lines: DataFrame) -> DataFrame:
    """Common and combined web access lines; the level is the status's."""
    g = lambda k: S._group(F.col("line"), P.ACCESS, k)
    d = _stripped(lines).where(F.col("line").rlike(P.ACCESS))
    status = g(6).cast("int")
    names = ("ip", "ident", "authuser", "timestamp", "request")
    return d.select(*_KEYS, *[g(k + 1).alias(n) for k, n in enumerate(names)], status.alias("status"), g(7).alias("body_bytes"), g(8).alias("referer"), g(9).alias("user_agent"), *_tail(F.col("line")), S.status_level(status).alias("log_level"))


def pairs(c: Column, pattern: str) -> Column:
    """Pairs of a line as map(key, text value): keys sanitized, quotes off, the last of equal keys stays."""
    found = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("v"))
    entries = F.transform(found, lambda x: F.struct(S.sanitize_identifier(x["k"]).alias("k"), F.trim(F.trim(x["v"]), F.lit('"')).alias("v")))
    return last_wins(entries)


def last_wins(entries: Column) -> Column:
    """The map of entries struct(k, v), of equal keys the last."""

    # an array of one binds an expression to a name, so that it is computed once
    def bound(c: Column, f: Callable[[Column], Column]) -> Column:
        return F.get(F.transform(F.array(c), f), F.lit(0))

    def to_map(es: Column) -> Column:
        # from behind, an entry is the first of its key
        last = lambda keys: F.filter(es, lambda e, i: F.array_position(keys, e["k"]) == F.size(keys) - i)
        return F.map_from_entries(bound(F.reverse(F.transform(es, lambda e: e["k"])), last))

    return bound(entries, to_map)


def _key_values(lines: DataFrame, pattern: str) -> DataFrame:
    # the pattern itself tells whether there is a pair, so that nothing builds maps that nobody reads
    d = _bare(lines).where(F.col("line").rlike(pattern)).withColumn("fields", pairs(F.col("line"), pattern))
    return d.select(*_KEYS, *_tail(F.col("line")), S.infer_level(F.col("line")).alias("log_level"), "fields")


def logfmt(lines: DataFrame) -> DataFrame:
    """Lines with at least one key=value; fields maps each key to its text."""
    return _key_values(lines, P.LOGFMT_PAIR)


def key_value(lines: DataFrame) -> DataFrame:
    """Lines with at least one key=value or key: value."""
    return _key_values(lines, P.KEY_VALUE_PAIR)


def plain(lines: DataFrame) -> DataFrame:
    """What any non-blank line gives: raw, message, level."""
    return _stripped(lines).select(*_KEYS, *_tail(F.col("line")), S.infer_level(F.col("line")).alias("log_level"))


def hex_dump(lines: DataFrame) -> DataFrame:
    """Bytes of dump lines: running offset, hex, ASCII, decoded text, timestamp. Other lines don't advance the offset.

    The offset is a prefix sum within a file.
    """
    digits = F.regexp_replace(F.regexp_extract("line", P.HEX_DUMP, 1), r"\s", "")
    d = lines.where(F.col("line").rlike(P.HEX_DUMP)).withColumn("hex_bytes", digits).where("length(hex_bytes) % 2 = 0 and hex_bytes != ''")
    d = d.withColumn("n", F.floor(F.length("hex_bytes") / 2))
    d = _with_running(_parted(d), "n", "upto").withColumn("offset", F.col("upto") - F.col("n"))
    raw = F.unhex("hex_bytes")
    latin = F.decode(raw, "ISO-8859-1")
    shown = F.regexp_replace(latin, r"[^\x20-\x7e]", ".")
    text = F.nullif(F.make_valid_utf8(raw.cast("string")), F.lit(""))
    return d.select(*_KEYS, "offset", "hex_bytes", shown.alias("ascii_repr"), F.replace(text, F.lit("�"), F.lit("")).alias("decoded_text"), S._group(shown, f"({P.ISO_TIMESTAMP})", 1).alias("timestamp"))


def printable_strings(files: DataFrame, limit: int | None = None) -> DataFrame:
    """Runs of four or more printable characters in content; with a limit the first of each file up to it."""
    runs = F.regexp_extract_all("content", F.lit(f"({P.PRINTABLE_RUN})"), F.lit(1))
    runs = runs if limit is None else F.slice(runs, 1, limit)
    d = files.select("file_id", "filename", F.posexplode(runs).alias("at", "text"))
    return d.select("file_id", "filename", (F.col("at") + 1).alias("string_index"), "text", S._group(F.col("text"), f"({P.ISO_TIMESTAMP})", 1).alias("timestamp"))


_ACCEPT = {"syslog": (P.SYSLOG, "not valid syslog format"), "access": (P.ACCESS, "not valid access log format"), "logfmt": (P.LOGFMT_PAIR, "no logfmt pairs"), "key_value": (P.KEY_VALUE_PAIR, "no key-value pairs")}


def rejected(lines: DataFrame, parser: str) -> DataFrame:
    """Warnings: the lines that a parser can't read."""
    pattern, reason = _ACCEPT[parser]
    return _stripped(lines).where(~F.col("line").rlike(pattern)).select(*_KEYS, F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(f": {reason}")).alias("warning"))


# -- units of several lines --------------------------------------------------------


def _with_offset(d: DataFrame) -> DataFrame:
    """Parted lines with offset: the characters of the file's lines before, ends of lines included."""
    d = _with_running(d.withColumn("chars", F.length("line") + 1), "chars", "upto")
    return d.withColumn("offset", F.col("upto") - F.col("chars")).drop("chars", "upto")


def blocks(lines: DataFrame, most: int | None = None) -> DataFrame:
    """Lines with their continuations (stack frames, causes, indented text) as one record.

    A blank line ends a block; any other line that continues nothing begins one.
    start_line, end_line, n_lines, raw. With most, raw is the first so many
    characters, and no more than the lines that hold them is gathered, however
    long the block.
    """
    d = _parted(lines).withColumn("blank", F.coalesce(F.btrim("line", F.lit(_SPACE)) == "", F.lit(True)))
    d = d.withColumn("more", F.coalesce(F.col("line").rlike(P.CONTINUATION), F.lit(False))).withColumn("after_blank", F.lag("blank").over(_inside()))
    opens = lambda blank, more, after_blank: (~blank & ~(more & ~after_blank)).cast("int")
    # whether a part's first line opens a block hangs on the part before
    d = d.withColumn("opens", F.when(F.col("after_blank").isNull(), 0).otherwise(opens(F.col("blank"), F.col("more"), F.col("after_blank"))))
    parts = d.groupBy("file_id", "part").agg(F.min_by(F.struct("blank", "more"), "line_no").alias("head"), F.max_by("blank", "line_no").alias("end"), F.sum("opens").alias("held"))
    ahead = F.coalesce(F.lag("end").over(Window.partitionBy("file_id").orderBy("part")), F.lit(True))
    parts = parts.withColumn("first", opens(F.col("head.blank"), F.col("head.more"), ahead))
    base = F.coalesce(F.sum(F.col("held") + F.col("first")).over(_parts_before()), F.lit(0)) + F.col("first")
    parts = parts.select("file_id", "part", base.alias("base"))
    d = d.withColumn("run", F.sum("opens").over(_inside())).join(parts, ["file_id", "part"]).withColumn("block", F.col("base") + F.col("run")).where(~F.col("blank")).drop("base", "run")
    taken = F.struct("line_no", "line")
    if most is not None:
        d = _with_offset(d)
        opened = d.groupBy("file_id", "block").agg(F.min("offset").alias("opened"))
        d = d.join(opened, ["file_id", "block"])
        taken = F.when(F.col("offset") - F.col("opened") < most, F.struct("line_no", F.substring("line", 1, most).alias("line")))
    told = F.sort_array(F.collect_list(taken))
    out = d.groupBy("file_id", "filename", "block").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"), told.alias("told"))
    raw = F.array_join(F.transform("told", lambda x: x["line"]), "\n")
    return out.select("file_id", "filename", "start_line", "end_line", "n_lines", (raw if most is None else F.substring(raw, 1, most)).alias("raw"))


def sections(lines: DataFrame) -> DataFrame:
    """key = value lines under --- name --- headers: section, key, kind and value; before any header it is general."""
    name = S.sanitize_identifier(F.regexp_extract(F.trim("line"), P.SECTION_NAME, 1))
    header = F.trim("line").rlike(P.SECTION_HEADER)
    d = _with_last(_parted(lines).withColumn("named", F.when(header, name)), "named", "section").withColumn("section", F.coalesce("section", F.lit("general")))
    pair = r"^\s*([^=:]+?)\s*(?:=|:\s)\s*(.*?)\s*$"
    d = d.where(~header & F.col("line").rlike(pair))
    cast = S.smart_cast(F.regexp_extract("line", pair, 2))
    return d.select(*_KEYS, "section", S.sanitize_identifier(F.regexp_extract("line", pair, 1)).alias("key"), cast["kind"].alias("kind"), cast["value"].alias("value"))


def file_units(lines: DataFrame, most: int = UNIT_CHARS) -> DataFrame:
    """A file as one record: start_line, end_line, raw (its first characters; only the lines that hold them are gathered)."""
    d = _with_offset(_parted(lines))
    told = F.sort_array(F.collect_list(F.when(F.col("offset") < most, F.struct("line_no", F.substring("line", 1, most).alias("line")))))
    g = d.groupBy("file_id", "filename").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), told.alias("told"))
    return g.select("file_id", "filename", "start_line", "end_line", F.substring(F.array_join(F.transform("told", lambda x: x["line"]), "\n"), 1, most).alias("raw"))


def line_units(lines: DataFrame) -> DataFrame:
    """A record for each non-blank line."""
    return _stripped(lines).select("file_id", "filename", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("raw"))


#: Formats whose lines are records of their own.
LINEWISE = ("syslog", "json_lines", "json_document", "csv", "apache_clf", "apache_access", "nginx_access", "logfmt")


def units(lines: DataFrame, formats: DataFrame | str) -> DataFrame:
    """Records of each file by its format (one for all, or file_id, format): lines where each is one, else blocks of continued lines.

    A file without a line has none.
    """
    if isinstance(formats, str):
        formats = lines.select("file_id").distinct().withColumn("format", F.lit(formats))
    of_lines = F.col("format").isin(*LINEWISE)
    own = formats.select("file_id", F.coalesce("format", F.lit("plain_text")).alias("format"))
    by_line = line_units(lines.join(own.where(of_lines).select("file_id"), "file_id", "left_semi"))
    by_block = blocks(lines.join(own.where(~of_lines).select("file_id"), "file_id", "left_semi"), UNIT_CHARS).drop("n_lines")
    return by_line.unionByName(by_block).join(own, "file_id")


def extract_fields(units: DataFrame, text: str = "raw") -> DataFrame:
    """Adds fields (map) and confidence by the first reading that applies: JSON .95, syslog .95, pairs .8, plain .6."""
    c = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    parsed = F.when(F.startswith(c, F.lit("{")), F.from_json(c, "map<string,string>"))
    found = pairs(c, P.KEY_VALUE_PAIR)
    is_syslog = c.rlike(P.SYSLOG)
    g = lambda k: S._group(c, P.SYSLOG, k)
    sys_map = F.map_from_arrays(F.array(*map(F.lit, ("timestamp", "hostname", "process", "message"))), F.array(g(2), g(3), g(4), F.substring(g(6), 1, MESSAGE_CHARS)))
    plain_map = F.create_map(F.lit("message"), F.substring(c, 1, MESSAGE_CHARS))
    d = units.withColumn("parsed", parsed).withColumn("found", found)
    own, some = F.col("parsed").isNotNull(), F.size("found") > 0
    d = d.withColumn("confidence", F.when(own, 0.95).when(is_syslog, 0.95).when(some, 0.8).otherwise(0.6))
    d = d.withColumn("fields", F.when(own, F.col("parsed")).when(is_syslog, sys_map).when(some, F.col("found")).otherwise(plain_map)).drop("parsed", "found")
    # maps with defaults: what the line itself says goes before
    more = F.map_from_arrays(F.array(*map(F.lit, ("message", "timestamp", "log_level"))), F.array(F.substring(c, 1, MESSAGE_CHARS), S.first_timestamp(c), S.level_word(c)))
    return d.withColumn("fields", _with_defaults(F.col("fields"), more))


def _with_defaults(m: Column, more: Column) -> Column:
    """Map column m and the entries of more that it lacks and that aren't null."""
    return F.map_concat(m, F.map_filter(more, lambda k, v: v.isNotNull() & ~F.map_contains_key(m, k)))


def prune(units: DataFrame, fmt: str | Column) -> DataFrame:
    """Drops units that are only a bracket or comma, and empty ones of low confidence in structured formats (a name or a column)."""
    fmt = F.lit(fmt) if isinstance(fmt, str) else fmt
    own = F.size(F.array_except(F.map_keys("fields"), F.array(*map(F.lit, ("message", "template_id", "template_skeleton")))))
    return units.where(~F.trim("raw").isin("{", "}", "[", "]", ",") & (~fmt.isin("json_lines", "csv", "syslog") | (own > 0) | (F.col("confidence") >= 0.8)))


def cover(units: DataFrame) -> DataFrame:
    """Every unit has a message and a log_level."""
    more = F.map_from_arrays(F.array(F.lit("message"), F.lit("log_level")), F.array(F.substring("raw", 1, MESSAGE_CHARS), S.infer_level(F.col("raw"))))
    return units.withColumn("fields", _with_defaults(F.col("fields"), more))


def to_rows(units: DataFrame, columns: list[str]) -> DataFrame:
    """Fields as columns; those not asked for are packed into extra as JSON."""
    wanted = [c for c in columns if c not in ("raw", "extra", "source", "parse_confidence")]
    rest = F.map_filter("fields", lambda k, v: ~k.isin(*wanted, "raw", "source"))
    extra = F.when(F.size(rest) > 0, F.to_json(rest))
    return units.select(F.col("filename").alias("source"), F.substring("raw", 1, RAW_CHARS).alias("raw"), F.bround("confidence", 3).alias("parse_confidence"), *[F.col("fields")[c].alias(c) for c in wanted], extra.alias("extra"))


def chunks(lines: DataFrame, target: int = 500) -> DataFrame:
    """Fixed chunks of lines: chunk (from 0), start_line, end_line, n_lines."""
    d = lines.withColumn("chunk", F.floor((F.col("line_no") - 1) / target))
    return d.groupBy("file_id", "chunk").agg(F.min("line_no").alias("start_line"), F.max("line_no").alias("end_line"), F.count("*").alias("n_lines"))


def boundaries(lines: DataFrame) -> DataFrame:
    """Where a file may be cut: section headers, and timestamped lines after one without a timestamp."""
    text = F.trim("line")
    stamp = text.rlike("^" + P.ISO_TIMESTAMP)
    d = _parted(lines).withColumns({"header": text.rlike(P.SECTION_HEADER), "stamp": stamp, "plain": F.coalesce((text != "") & ~stamp, F.lit(False))})
    d = _with_before(d, "plain", "after_plain")
    cut = F.col("header") | (F.col("stamp") & F.col("after_plain"))
    return d.where((F.col("line_no") > 1) & cut).select(*_KEYS, F.when(F.col("header"), "section").otherwise("timestamp").alias("reason"))


def packed_chunks(lines: DataFrame, target: int = 500, most: int = 2000) -> DataFrame:
    """Chunks that end at boundaries: sections are packed up to target lines, one above most is cut; without boundaries every target lines.

    Where a chunk ends depends on where it begins alone, so every boundary knows
    the next cut if a chunk began there. Which of them are cuts is found by
    pointer doubling: in each round all known cuts tell the cuts twice as far on.
    A file of n sections takes log n rounds, and no task holds a file.
    """
    ends = written(lines.groupBy("file_id").agg((F.max("line_no") + 1).alias("end")))
    found = boundaries(lines).select("file_id", F.col("line_no").alias("at")).distinct()
    even = ends.join(found.select("file_id").distinct(), "file_id", "left_anti").select("file_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("end") - 1, F.lit(target).cast("long"))).alias("at"))
    starts = found.unionByName(even).unionByName(ends.select("file_id", F.lit(1).cast("long").alias("at"))).distinct()
    edges = starts.unionByName(ends.select("file_id", F.col("end").alias("at"))).distinct().withColumn("line_no", F.col("at"))
    # the edge after each: in its part, or the first one of the parts that follow
    parted = _parted(edges)
    after = Window.partitionBy("file_id").orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    heads = parted.groupBy("file_id", "part").agg(F.min("at").alias("head")).select("file_id", "part", F.min("head").over(after).alias("beyond"))
    sections = parted.withColumn("to", F.lead("at").over(_inside())).join(heads, ["file_id", "part"]).select("file_id", "at", F.coalesce("to", "beyond").alias("to"))
    # the last edge within target lines: edges meet in stretches of target lines, each in its own and in the one before
    stretch = F.floor(F.col("at") / target)
    near = edges.select("file_id", "at", F.explode(F.array(F.struct(stretch.alias("s"), F.lit(True).alias("own")), F.struct((stretch - 1).alias("s"), F.lit(False).alias("own")))).alias("x"))
    within = Window.partitionBy("file_id", "x.s").orderBy("at").rangeBetween(0, target)
    last = near.withColumn("last", F.max("at").over(within)).where("x.own").select("file_id", "at", "last")
    jumps = sections.where(F.col("to").isNotNull()).join(last, ["file_id", "at"])
    jumps = written(jumps.select("file_id", "at", "to", F.when(F.col("to") - F.col("at") > most, F.col("to")).otherwise(F.greatest("to", "last")).alias("next")))
    cuts, known, far = written(ends.select("file_id", F.lit(1).cast("long").alias("at"))), 0, jumps.select("file_id", "at", "next")
    while known != (known := cuts.count()):
        cuts = written(cuts.unionByName(cuts.join(far, ["file_id", "at"]).select("file_id", F.col("next").alias("at"))).distinct())
        far = written(far.alias("a").join(far.alias("b"), (F.col("a.file_id") == F.col("b.file_id")) & (F.col("a.next") == F.col("b.at")), "left").select("a.file_id", "a.at", F.coalesce("b.next", "a.next").alias("next")))
    chunks_ = cuts.join(jumps, ["file_id", "at"])
    large = F.col("to") - F.col("at") > most
    pieces = F.transform(F.sequence(F.col("at"), F.col("to") - 1, F.lit(target).cast("long")), lambda k: F.struct(k.alias("a"), (F.least(k + target, F.col("to")) - 1).alias("b")))
    whole = F.array(F.struct(F.col("at").alias("a"), (F.col("next") - 1).alias("b")))
    d = chunks_.select("file_id", F.explode(F.when(large, pieces).otherwise(whole)).alias("x")).select("file_id", F.col("x.a").alias("line_no"), F.col("x.b").alias("end_line"))
    return numbered_rows(d).select("file_id", (F.col("row_no") - 1).alias("chunk"), F.col("line_no").alias("start_line"), "end_line")
