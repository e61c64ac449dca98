"""From files to typed tables: detect, route, parse, infer, gate, fall back, merge, persist."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import anomaly, cache, detect, line_parsers, quality, schema, structured, templates
from ..sources import binary
from ..sources import files as files_of
from ..sources.lines import lines_of
from ..sources.shared import written
from ..streaming import stores
from .catalog import Catalog

#: A parser takes files and lines and gives records: file_id, filename, logical_name, row_no, fields.
Parser = Callable[[DataFrame, DataFrame], DataFrame]


def _records(d: DataFrame, name: str, columns: list[str], more: str | None = None) -> DataFrame:
    """Rows of a line parser as records."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, ["source", *columns])), F.array(F.col("filename"), *[F.col(c).cast("string") for c in columns]))
    fields = F.map_filter(pairs, lambda k, v: v.isNotNull())
    if more:
        fields = F.map_concat(F.map_filter(fields, lambda k, v: ~F.map_contains_key(F.col(more), k)), F.col(more))
    return d.select("file_id", "filename", F.lit(name).alias("logical_name"), F.col("line_no").alias("row_no"), fields.alias("fields"))


_SYSLOG = ["timestamp", "host", "process", "pid", "message", "raw", "log_level", "syslog_pri", "syslog_facility", "syslog_severity"]
_ACCESS = ["ip", "ident", "authuser", "timestamp", "request", "status", "body_bytes", "referer", "user_agent", "raw", "message", "log_level"]
_TEXT = ["raw", "message", "log_level"]
_HEX = ["offset", "hex_bytes", "ascii_repr", "decoded_text", "timestamp"]


def _json(files: DataFrame, lines: DataFrame) -> DataFrame:
    whole = S.is_json(F.trim("content"))
    return structured.json_documents(files.where(whole)).unionByName(structured.json_lines(lines.join(files.where(~whole).select("file_id"), "file_id", "left_semi")))


def _unified(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Units as each file's format asks for: JSON documents or objects, rows under a header, XML elements by their leaves, else lines or blocks; pruned and covered.

    A JSON or comma-separated file that gives none is read by lines.
    """
    seen = detect.classify(files, lines).select("file_id", "filename", "detected_format")
    formats = written(detect.unified_format(lines, seen))
    of = lambda fmt: formats.where(F.col("format") == fmt).select("file_id")
    rows = structured.comma_units(lines.join(of("csv"), "file_id", "left_semi"))
    objects = structured.json_units(*[d.join(of("json_lines"), "file_id", "left_semi") for d in (files, lines)])
    own = written(rows.unionByName(objects))
    rest = lines.join(own.select("file_id").distinct(), "file_id", "left_anti")
    found = line_parsers.extract_fields(line_parsers.units(rest, formats))
    found = found.unionByName(own.join(formats, "file_id"))
    xml = F.col("format") == "xml"
    found = found.where(~xml).unionByName(structured.with_xml_fields(found.where(xml)).select(*found.columns))
    units = line_parsers.cover(line_parsers.prune(found, F.col("format")))
    fields = F.map_concat(F.create_map(F.lit("source"), F.col("filename"), F.lit("raw"), F.substring("raw", 1, 4000), F.lit("parse_confidence"), F.col("confidence").cast("string")), F.map_filter("fields", lambda k, v: ~k.isin("source", "raw", "parse_confidence")))
    return units.select("file_id", "filename", F.lit("unified").alias("logical_name"), F.col("start_line").alias("row_no"), fields.alias("fields"))


PARSERS: dict[str, Parser] = {
    "json_lines": _json,
    "csv": lambda files, lines: structured.delimited(lines),
    "xml": lambda files, lines: structured.xml_documents(files),
    "syslog": lambda files, lines: _records(line_parsers.syslog(lines), "syslog", _SYSLOG),
    "apache_access": lambda files, lines: _records(line_parsers.access(lines), "access", _ACCESS),
    "nginx_access": lambda files, lines: _records(line_parsers.access(lines), "access", _ACCESS),
    "logfmt": lambda files, lines: _records(line_parsers.logfmt(lines), "logfmt", _TEXT, "fields"),
    "key_value": lambda files, lines: _records(line_parsers.key_value(lines), "key_value", _TEXT, "fields"),
    "binary_hex": lambda files, lines: _records(line_parsers.hex_dump(lines), "hex_dump", _HEX),
    "unified": _unified,
}
#: Parsers whose failed gate sends a file to the unified one, and how sure that can be.
FALL_BACK, FALLBACK_CONFIDENCE = ("csv", "json_lines", "xml"), 0.45


def register_parser(key: str, parser: Parser) -> None:
    """Adds a parser, or replaces one."""
    PARSERS[key] = parser


@dataclass
class Parsed:
    """Tables by name with their columns and verdicts."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    columns: dict[str, list[schema.Column]] = field(default_factory=dict)
    reports: dict[str, quality.GateReport] = field(default_factory=dict)
    parser_key: str = ""
    confidence: float = 0.0
    warnings: list[str] = field(default_factory=list)

    @property
    def relationships(self) -> list[schema.Relationship]:
        return schema.relationships(list(self.tables))


def required_columns(columns: list[schema.Column]) -> list[str]:
    """Columns that every record has."""
    return ["id_value" if c.name == "id" else c.name for c in columns if not c.nullable]


def readable(raw: DataFrame) -> DataFrame:
    """(file_id, filename, content) of files (file_id, filename, bytes): text as it is, binary files by what can be read of them.

    Binary is what its name or its first bytes tell, or what holds more than a tenth of characters that can't be shown.
    """
    text = files_of.decode_bytes(raw)
    odd = binary.unprintable_share(F.col("content")) > binary.BINARY_SHARE
    told = raw.where(files_of.is_binary_name(F.col("filename")) | files_of.magic(F.col("bytes")).isNotNull()).select("file_id").unionByName(text.where(odd).select("file_id")).distinct()
    told = written(told)
    return text.join(told, "file_id", "left_anti").unionByName(binary.decode(raw.join(told, "file_id", "left_semi")).drop("kind"))


def parse_with(key: str, files: DataFrame, lines: DataFrame) -> Parsed:
    """Parses all files with one parser; a file without a record becomes plain lines."""
    records = PARSERS[key](files, lines)
    if key not in ("unified",):
        left = lines.join(records.select("file_id").distinct(), "file_id", "left_anti")
        plain = line_parsers.plain(left).withColumn("source_file", F.col("filename"))
        records = records.unionByName(_records(plain, "lines", ["source_file", *_TEXT]).select(*records.columns))
    # what a line parser took over from the line stays as it was
    as_is = ("source_file",) if key in FALL_BACK else ("source_file", "source", "raw", "message", "log_level")
    records = written(schema.normalized(records, as_is=as_is))  # read once for the schema and once for each table
    columns = schema.columns_of(schema.infer(records))
    tables = {name: schema.typed(records.where(F.col("logical_name") == name), cols) for name, cols in columns.items()}
    trace = quality.TRACE_FIELDS if key in ("syslog", "logfmt", "key_value", "apache_access", "nginx_access") else ()
    report = quality.gate(tables, {n: required_columns(c) for n, c in columns.items()}, trace)
    confidence = max(0.05, 0.95 - report.penalty)
    return Parsed(tables, columns, {key: report}, key, min(confidence, 0.25) if report.fall_back else confidence, [f"{t.table}: {w}" for t in report.tables for w in t.warnings])


def parse(files: DataFrame, known: DataFrame | None = None, discover: bool = False) -> Parsed:
    """Classifies files (file_id, filename, content), parses each with its parser and merges the tables.

    With discover, each file goes to the parser with the best claim on its name
    and content instead of the one for its detected format. The verdicts, one row for each parser, and the inferred columns are all
    that comes to the driver.
    """
    lines = lines_of(files)
    routed = detect.discovered(files, lines).where("rank = 0") if discover else detect.classify(files, lines, known)
    routed = routed.select("file_id", "parser_key")
    routed = written(routed)
    keys = [r.parser_key for r in routed.select("parser_key").distinct().orderBy("parser_key").collect()]
    parts = []
    for key in keys:
        own = routed.where(F.col("parser_key") == key).select("file_id")
        f, l = files.join(own, "file_id", "left_semi"), lines.join(own, "file_id", "left_semi")
        p = parse_with(key, f, l)
        if key in FALL_BACK and p.reports[key].fall_back:
            why = p.warnings
            p = parse_with("unified", f, l)
            p.confidence = min(p.confidence, FALLBACK_CONFIDENCE)
            p.warnings = why + [f"{key}: quality gate failed, parsed as unified."] + p.warnings
        parts.append(p)
    return merge(parts)


def merge(parts: list[Parsed]) -> Parsed:
    """Tables of several parsers together; tables of equal name are united."""
    if len(parts) == 1:
        return parts[0]
    out = Parsed(parser_key="mixed" if parts else "")
    for p in parts:
        for name, t in p.tables.items():
            if name in out.tables:
                a, b = out.tables[name], t
                for c in set(a.columns) & set(b.columns):
                    if dict(a.dtypes)[c] != dict(b.dtypes)[c]:
                        a, b = a.withColumn(c, F.col(c).cast("string")), b.withColumn(c, F.col(c).cast("string"))
                out.tables[name] = a.unionByName(b, allowMissingColumns=True)
                out.columns[name] = list({c.name: c for c in out.columns[name] + p.columns[name]}.values())
            else:
                out.tables[name], out.columns[name] = t, p.columns[name]
        out.reports |= p.reports
        out.warnings += p.warnings
    out.confidence = round(sum(p.confidence for p in parts) / len(parts), 2) if parts else 0.0
    return out


def persist(parsed: Parsed, catalog: Catalog, prefix: str = "") -> list[str]:
    """One write for each table; gives their names."""
    for name, df in parsed.tables.items():
        catalog.create(prefix + name, df, parsed.columns[name])
    return [prefix + n for n in parsed.tables]


def reprocess(parsed: Parsed, catalog: Catalog, before: list[str], prefix: str = "") -> list[str]:
    """Drops what an earlier run wrote, then writes."""
    for name in before:
        catalog.drop(name)
    return persist(parsed, catalog, prefix)


def feedback(classified: DataFrame, domain: str = "unknown", profile: str = "default") -> DataFrame:
    """What a run teaches the schema cache: an entry for each fingerprint."""
    c = classified.where("fingerprint is not null")
    return c.select(cache.schema_key(F.col("detected_format"), F.lit(domain), F.lit(profile), F.col("fingerprint")).alias("schema_key"), "fingerprint", F.lit(domain).alias("domain"), F.lit(profile).alias("profile"), "detected_format", "format_confidence", "structural_class", F.lit(1).cast("long").alias("successes"), F.lit(0).cast("long").alias("failures"), F.lit(1).cast("long").alias("access_count"), F.current_timestamp().alias("updated_at")).dropDuplicates(["schema_key"])


def learn(classified: DataFrame, inbox: str, ok: bool, at: Column | None = None, domain: str = "unknown", profile: str = "default") -> None:
    """Drops a run's outcome for each fingerprint into the folder that the stream of streaming.stores reads."""
    told = feedback(classified, domain, profile).withColumns({"ok": F.lit(ok), "at": F.current_timestamp() if at is None else at.cast("timestamp")})
    columns = [F.col(c).cast(k).alias(c) for c, k in (x.split(" ") for x in stores.OUTCOMES.split(", "))]
    told.select(*columns).write.mode("append").parquet(inbox)


def insights(spark: SparkSession, lines: DataFrame, write: Callable[[dict], str] | None = None) -> dict:
    """Severity, most frequent error templates and findings of lines; write(facts) may tell them in words."""
    units = line_parsers.cover(line_parsers.extract_fields(line_parsers.blocks(lines)))
    found = anomaly.summary(anomaly.report(units)).first().asDict()
    errors = templates.top(templates.counts(lines.where(anomaly.is_error(F.col("line"), S.level_word(F.col("line"))))), 5).collect()
    facts = {"severity": next((s for s in anomaly.SEVERITIES if found[s]), "none"), "anomalies": found, "top_errors": [{"skeleton": r.skeleton, "count": r["count"]} for r in errors]}
    facts["narrative"] = write(facts) if write else f"{sum(found.values())} findings, worst severity {facts['severity']}."
    return facts
