"""Format detection and file statistics, over the lines of all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..operators import detect, line_parsers, schema
from ..sources import binary
from ..sources import files as sources
from ..sources.lines import sample
from ..sources.shared import written
from .base import ACCESS, DOC_LINES, JSON_TEXT, LOGFMT, SYSLOG, TRACE, access_lines, document_lines, json_text_lines, logfmt_lines, registry, sample_sql, syslog_lines, table, trace_lines

QUERIES, query = registry()

S50, S100 = f"WITH {DOC_LINES}, {sample_sql(50)}", f"WITH {DOC_LINES}, {sample_sql(100)}"


@query(f"""{S100} SELECT file_id, substr(sha256(string_agg(substr(line, 1, 200), chr(10) ORDER BY pos)), 1, 16) AS fingerprint FROM s WHERE pos <= 20 GROUP BY file_id""")
def content_fingerprints(spark, d):
    return detect.content_fingerprint(sample(document_lines(spark, d), 100))


@query(f"""{S100} SELECT file_id, count(*) AS sample_lines, round_even(avg(length(line)), 1) AS avg_line_length, round_even(stddev_pop(length(line)), 1) AS line_length_std,
  avg(CASE WHEN regexp_matches(line, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}') THEN 1.0 ELSE 0.0 END) > 0.3 AS has_timestamps,
  avg(CASE WHEN regexp_matches(line, '(?i)\\b(TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\\b') THEN 1.0 ELSE 0.0 END) > 0.3 AS has_log_levels FROM s GROUP BY file_id""")
def line_statistics(spark, d):
    return detect.line_stats(sample(document_lines(spark, d), 100))


@query(f"""{S100} SELECT file_id, """ + ", ".join(f"CAST(sum(length(line) - length(replace(line, {m}, ''))) AS BIGINT) AS {k}" for k, m in (("comma", "','"), ("tab", "chr(9)"), ("pipe", "'|'"), ("equals", "'='"), ("colon", "':'"))) + " FROM s WHERE pos <= 50 GROUP BY file_id")
def delimiter_counts(spark, d):
    return detect.delimiter_counts(sample(document_lines(spark, d), 100))


def _mixed(spark, d):
    """Files of five formats, one of each for every user."""
    out = None
    for k, f in (("s", syslog_lines), ("a", access_lines), ("l", logfmt_lines), ("j", json_text_lines), ("t", trace_lines)):
        x = f(spark, d).withColumn("file_id", F.concat("file_id", F.lit(k)))
        out = x if out is None else out.unionByName(x)
    return out


def _mixed_sql(n: int) -> str:
    """CTE s of the first n lines of those files."""
    kinds = {"s": SYSLOG, "a": ACCESS, "l": LOGFMT, "j": JSON_TEXT, "t": TRACE}
    parts = ", ".join(x.replace("lines AS", f"l{k} AS", 1) for k, x in kinds.items())
    return f"WITH {parts}, lines AS (" + " UNION ALL ".join(f"SELECT file_id || '{k}' AS file_id, filename, line_no, line FROM l{k}" for k in kinds) + f"), {sample_sql(n)}"


def _hit(pattern: str, c: str = "line") -> str:
    return "regexp_matches({0}, '{1}')".format(c, pattern.replace("'", "''"))


def _share(hit: str) -> str:
    return f"avg(CASE WHEN {hit} THEN 1e0 ELSE 0e0 END)"


def _commas(k: int = 0) -> str:
    return f"coalesce(avg(CASE WHEN pos BETWEEN 2 AND 10 THEN CASE WHEN h{k} > 0 AND n{k} = h{k} THEN 1e0 ELSE 0e0 END END), 0e0)"


_counted = ", ".join(f"length(line) - length(replace(line, {m}, '')) AS n{k}, first_value(length(line) - length(replace(line, {m}, ''))) OVER (PARTITION BY file_id ORDER BY pos) AS h{k}" for k, m in enumerate(("','", "chr(9)", "'|'", "';'")))
_SCORES = {
    "json_lines": _share(_hit(P.JSON_LINE)),
    "json_document": f"CASE WHEN {_share(_hit(P.JSON_LINE))} = 0 THEN least(85e-2, avg(CASE WHEN pos <= 10 THEN CASE WHEN {_hit(P.JSON_OPEN)} THEN 1e0 ELSE 0e0 END END)) ELSE 0e0 END",
    "xml": _share(_hit(P.XML_TAG)),
    "csv": _commas(),
    "syslog": _share(_hit(P.SYSLOG_START)),
    "apache_clf": _share(_hit(P.ACCESS_START)),
    "logfmt": _share(_hit(P.LOGFMT_LINE)),
    "key_value": f"{_share(_hit(P.KEY_VALUE_LINE))} * 8e-1",
    "hex_dump": _share(_hit(P.HEX_DUMP_START)),
    "section_delimited": _share(_hit(P.SECTION_HEADER)),
}
_MIX = f"{_mixed_sql(100)}, c AS (SELECT *, {_counted} FROM s)"


@query(f"{_MIX} SELECT file_id, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in _SCORES.items()) + " FROM c GROUP BY file_id")
def format_scores(spark, d):
    """How much each file looks like each of the ten formats."""
    scores = detect.format_scores(sample(_mixed(spark, d), 100))
    return scores.select("file_id", *[F.round(c, 6).alias(c) for c in detect.FINGERPRINT_FORMATS])


_marks = ("','", "chr(9)", "'|'", "';'")
_heads = ", ".join(f"first_value(length(line) - length(replace(line, {m}, ''))) OVER (PARTITION BY file_id ORDER BY pos) AS h{k}" for k, m in enumerate(_marks))
_scores = ", ".join(f"coalesce(avg(CASE WHEN pos > 1 THEN CASE WHEN h{k} > 0 AND length(line) - length(replace(line, {m}, '')) = h{k} THEN 1.0 ELSE 0.0 END END), 0)" for k, m in enumerate(_marks))


@query(f"{S50}, h AS (SELECT *, {_heads} FROM s WHERE pos <= 10) SELECT file_id, round(greatest({_scores}), 6) AS csv FROM h GROUP BY file_id")
def csv_scores(spark, d):
    s = sample(document_lines(spark, d), 50)
    return detect.delimiter_score(s, (",", "\t", "|", ";")).select("file_id", F.round("csv", 6).alias("csv"))


@query()
def classified_files(spark, d):
    """Format, class, parser and segmentation of files of five formats; tests hold it against the fixtures."""
    lines = _mixed(spark, d)
    told = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    files = lines.groupBy("file_id", "filename").agg(F.array_join(F.transform(told, lambda x: x["line"]), "\n").alias("content"))
    files = written(files)
    lines = files.select("file_id", "filename", F.posexplode(F.split("content", "\n")).alias("at", "line")).selectExpr("file_id", "filename", "cast(at + 1 as bigint) as line_no", "line")
    return detect.classify(files, lines)


@query(f"""WITH {TRACE}, g AS (SELECT file_id, count(*) AS n, avg(CASE WHEN regexp_matches(line, '^(?:\\s+at\\s|Caused by:|\\.{{3}}\\s*\\d+\\s*more|\\s{{4,}}\\S|\\t\\S)') THEN 1.0 ELSE 0.0 END) AS r FROM lines GROUP BY 1)
SELECT file_id, CASE WHEN n <= 3 THEN 'per_file' WHEN r > 0.15 THEN 'per_multiline_cluster' ELSE 'per_line' END AS strategy, CASE WHEN n <= 3 THEN 0.7 WHEN r > 0.15 THEN CAST(round_even(CAST(least(0.6 + r, 0.95) AS DOUBLE), 2) AS DOUBLE) ELSE 0.9 END AS confidence FROM g""")
def segmentation_hints(spark, d):
    lines = trace_lines(spark, d)
    return detect.segmentation(lines, lines.select("file_id").distinct().withColumn("detected_format", F.lit("plain_text")))


_names = lambda formats: ", ".join(f"'{f}'" for f in formats)
_PRINTS = f"""{_MIX}, m AS (SELECT file_id, {", ".join(f"{v} AS {k}" for k, v in _SCORES.items())}, round_even(avg(length(line)), 1) AS len,
  {_share(_hit(P.ISO_TIMESTAMP))} > 0.3 AS stamps, {_share(_hit(P.LEVEL_HINT))} > 0.3 AS levels,
  substr(sha256(string_agg(substr(line, 1, 200), chr(10) ORDER BY pos) FILTER (WHERE pos <= 20)), 1, 16) AS fp FROM c GROUP BY file_id),
f AS (SELECT *, CASE {" ".join(f"WHEN {k} > 0 AND {k} = greatest({', '.join(_SCORES)}) THEN '{k}'" for k in _SCORES)} ELSE 'plain_text' END AS fmt FROM m),
p AS (SELECT *, CASE WHEN fmt IN ({_names(detect.STRUCTURED)}) THEN 'structured' WHEN fmt IN ({_names(detect.SEMI_STRUCTURED)}) THEN 'semi_structured' ELSE 'unstructured' END AS class FROM f)"""


@query(f"""{_PRINTS}, k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY fp ORDER BY fmt, class, stamps, levels, len) = 1),
x AS (SELECT a.fp AS fp, b.fp AS "similar", CASE WHEN a.fmt = b.fmt THEN 4e-1 ELSE 0e0 END + CASE WHEN a.class = b.class THEN 2e-1 ELSE 0e0 END + CASE WHEN a.stamps = b.stamps THEN 1e-1 ELSE 0e0 END
  + CASE WHEN a.levels = b.levels THEN 1e-1 ELSE 0e0 END + 2e-1 * least(a.len, b.len) / greatest(a.len, b.len, 1e0) AS score FROM p a JOIN k b ON a.fmt = b.fmt AND a.fp <> b.fp)
SELECT fp AS fingerprint, "similar", round_even(score, 6) AS score FROM x WHERE score >= 85e-2 QUALIFY row_number() OVER (PARTITION BY fp ORDER BY score DESC, "similar" DESC) = 1""")
def similar_formats(spark, d):
    """The most similar other fingerprint of every file of five formats."""
    prints = detect.fingerprints(_mixed(spark, d))
    return detect.similar_formats(prints, prints, 0.85)


@query(f"WITH {DOC_LINES} SELECT file_id, (line_no - 1) // 500 AS chunk, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines FROM lines GROUP BY ALL")
def fixed_chunks(spark, d):
    return line_parsers.chunks(document_lines(spark, d))


_ISO = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}"


@query(f"""WITH {TRACE}, b AS (SELECT *, lag(trim(line)) OVER (PARTITION BY file_id ORDER BY line_no) AS before FROM lines)
SELECT file_id, filename, line_no, 'timestamp' AS reason FROM b WHERE line_no > 1 AND regexp_matches(line, '{_ISO}') AND before <> '' AND NOT regexp_matches(before, '{_ISO}')""")
def chunk_boundaries(spark, d):
    return line_parsers.boundaries(trace_lines(spark, d))


@query("""WITH RECURSIVE e AS (SELECT CAST(event_id // 5000 AS VARCHAR) AS file_id, event_id % 5000 + 1 AS line_no, event_id % 40 = 0 AND event_id % 5000 > 0 AS cut FROM events),
n AS (SELECT file_id, max(line_no) AS n FROM e GROUP BY 1), edges AS (SELECT file_id, line_no AS edge FROM e WHERE cut UNION ALL SELECT file_id, n + 1 FROM n),
p AS (SELECT file_id, 0 AS chunk, CAST(1 AS BIGINT) AS start_line, (SELECT max(edge) FROM edges x WHERE x.file_id = n.file_id AND edge <= 501) AS nxt FROM n
  UNION ALL SELECT p.file_id, p.chunk + 1, p.nxt, (SELECT max(edge) FROM edges x WHERE x.file_id = p.file_id AND edge <= p.nxt + 500) FROM p JOIN n USING (file_id) WHERE p.nxt <= n.n)
SELECT file_id, CAST(chunk AS BIGINT) AS chunk, start_line, nxt - 1 AS end_line FROM p""")
def packed_chunks(spark, d):
    """Chunks of the event log as files of 5000 lines with a section every 40, cut at sections."""
    e = table(spark, d, "events").selectExpr("cast(event_id div 5000 as string) as file_id", "concat('part-', event_id div 5000) as filename", "event_id % 5000 + 1 as line_no", "if(event_id % 40 = 0, concat('--- part ', event_id, ' ---'), cast(value as string)) as line")
    return line_parsers.packed_chunks(e)


@query(f"""WITH {DOC_LINES}, g AS (SELECT file_id, bool_or(lower(line) LIKE '%timestamp%' OR regexp_matches(line, '\\d{{4}}-\\d{{2}}-\\d{{2}}')) AS ts, bool_or(lower(line) LIKE '%error%' OR lower(line) LIKE '%exception%') AS err FROM lines WHERE line_no <= 20 GROUP BY 1)
SELECT file_id, 'message,log_level,source' || CASE WHEN ts THEN ',timestamp' ELSE '' END || CASE WHEN err THEN ',error_code' ELSE '' END AS columns FROM g""")
def fallback_schemas(spark, d):
    return schema.fallback_columns(document_lines(spark, d)).select("file_id", F.array_join("columns", ",").alias("columns"))


@query(f"""WITH {LOGFMT} SELECT file_id, n.name, round_even(1 - avg(CASE WHEN regexp_matches(lower(line), '\\b(?:' || n.name || '|' || replace(n.name, '_', ' ') || ')\\s*[:=]') THEN 1.0 ELSE 0.0 END), 3) AS null_rate
FROM lines, (VALUES ('user_id'), ('cents'), ('missing')) n(name) GROUP BY ALL""")
def estimated_null_rates(spark, d):
    return schema.estimated_null_rate(logfmt_lines(spark, d), ["user_id", "cents", "missing"])


@query("""SELECT doc_id, length(CAST(text AS BLOB)) AS size, sha256(text) AS sha256, CASE WHEN hex(text) LIKE '504B0304%' THEN 'zip' WHEN hex(text) LIKE '4D5A%' THEN 'pe_executable' END AS kind FROM documents""".replace("length(CAST(text AS BLOB))", "CAST(strlen(text) AS BIGINT)"))
def file_digests(spark, d):
    """What an upload notes of each file: size, hash, binary kind."""
    files = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("filename"), F.col("text").cast("binary").alias("bytes"))
    kinds = files.select("doc_id", "file_id", sources.magic(F.col("bytes")).alias("kind"))
    return kinds.join(sources.digest(files), "file_id").select("doc_id", "size", "sha256", "kind")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents), n AS (SELECT doc_id, ch, count(*) AS k FROM c WHERE ch <> '' GROUP BY ALL),
t AS (SELECT doc_id, sum(k) AS total FROM n GROUP BY 1) SELECT doc_id, round(-sum(k / total * log2(k / total)), 6) AS entropy FROM n JOIN t USING (doc_id) GROUP BY doc_id""")
def character_entropy(spark, d):
    """Shannon entropy of each document's characters."""
    files = table(spark, d, "documents").where("text != ''").select(F.col("doc_id").alias("file_id"), F.col("text").alias("content"))
    return binary.character_entropy(files).select(F.col("file_id").alias("doc_id"), F.round("entropy", 6).alias("entropy"))


@query("SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE format('{:.1f}', round(n_chars / 1024.0, 1)) || ' KB' END AS label FROM documents")
def size_labels(spark, d):
    return table(spark, d, "documents").select("doc_id", S.size_label(F.col("n_chars")).alias("label"))


@query("SELECT event_id, event_type || ' by ' || user_id AS b64, event_type || '-' || user_id || '-abcdefgh' AS hexed FROM events")
def encoded_frames(spark, d):
    """Texts hidden in base64 frames and hex lines."""
    e = table(spark, d, "events")
    told = F.concat("event_type", F.lit(" by "), "user_id")
    frame = F.concat(F.lit("noise\nBEGIN_B64\n"), F.base64(told.cast("binary")), F.lit("\nEND_B64\nmore"))
    line = F.concat(F.lit("zz\n"), F.hex(F.concat("event_type", F.lit("-"), "user_id", F.lit("-abcdefgh"))), F.lit("\nshort"))
    return e.select("event_id", binary.base64_text(frame).alias("b64"), binary.hex_text(line).alias("hexed"))


@query("WITH n AS (SELECT doc_id, length(regexp_replace(array_to_string(list_slice(string_split(text, chr(10)), 1, 100), ''), '[^\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{9f}]', '', 'g')) AS odd FROM documents) SELECT doc_id, odd > 0 AS any_odd FROM n")
def unprintable_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", (binary.unprintable_share(F.col("text")) > 0).alias("any_odd"))


_clf = _share(_hit(P.ACCESS))
_nginx = _share(_hit(P.ACCESS) + " AND " + _hit("nginx|upstream", "lower(line)"))
_times = lambda p: "len(regexp_extract_all(line, '{}'))".format(p.replace("'", "''"))
_dumps = f"count(*) FILTER (WHERE {_hit(P.HEX_DUMP)})"
_CLAIMS = (
    ("json_lines", _share(_hit(r"^\{[\s\S]*\}$", "trim(line)"))),
    ("csv", f"CASE WHEN {_dumps} >= 3 THEN 0e0 ELSE greatest({', '.join(_commas(k) for k in range(4))}) END"),
    ("xml", f"max(CASE WHEN pos = 1 AND {_hit('^<[A-Za-z?!_]', 'trim(line)')} THEN 95e-2 ELSE 0e0 END)"),
    ("syslog", _share(_hit(P.SYSLOG))),
    ("apache_access", _clf),
    ("nginx_access", f"CASE WHEN {_nginx} > 0 THEN {_nginx} ELSE {_clf} END"),
    ("logfmt", _share(f"{_times(P.LOGFMT_PAIR)} >= 2")),
    ("key_value", _share(f"{_times(P.KEY_VALUE_PAIR)} >= 2")),
    ("binary_hex", f"CASE WHEN {_dumps} >= 3 THEN 1e0 WHEN avg({_times(chr(92) + 'b[0-9a-fA-F]{2}' + chr(92) + 'b')}) >= 8 THEN 85e-2 ELSE 0e0 END"),
)
_claimed = " UNION ALL ".join(f"SELECT file_id, {k} AS nth, '{name}' AS parser_key, {name} AS score FROM g" for k, (name, _) in enumerate(_CLAIMS))


@query(f"""{_mixed_sql(25)}, c AS (SELECT *, {_counted} FROM s), g AS (SELECT file_id, {", ".join(f"{v} AS {k}" for k, v in _CLAIMS)} FROM c GROUP BY file_id), u AS ({_claimed})
SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY score DESC, nth) - 1 AS INT) AS rank, parser_key, round_even(score, 2) AS score FROM u WHERE score > 0""")
def parser_claims(spark, d):
    """Which parsers have a claim on files of five formats."""
    return detect.parser_support(_mixed(spark, d))


@query(f"""{_mixed_sql(30)}, t AS (SELECT file_id, pos, trim(line) AS c FROM s),
g AS (SELECT file_id, count(*) FILTER (WHERE pos <= 10 AND c LIKE '%,%') >= 3 AND count(*) FILTER (WHERE pos <= 10 AND c LIKE '%{{%') = 0 AS commas, bool_and(pos > 10 OR {_hit('^[{].*[}]$', 'c')}) AS objects,
  bool_or(pos <= 10 AND {_hit('^<.*>$', 'c')}) AS tags, count(*) FILTER (WHERE pos <= 20 AND (c LIKE '<%Mar %' OR c LIKE '<%Jan %')) >= 3 AS dated FROM t GROUP BY file_id)
SELECT file_id, CASE WHEN commas THEN 'csv' WHEN objects THEN 'json_lines' WHEN tags THEN 'xml' WHEN dated THEN 'syslog' ELSE 'plain_text' END AS format FROM (SELECT DISTINCT file_id FROM lines) LEFT JOIN g USING (file_id)""")
def unified_formats(spark, d):
    """How the unified parser reads files of five formats."""
    m = _mixed(spark, d)
    return detect.unified_format(m, m.select("file_id", "filename").distinct().withColumn("detected_format", F.lit("plain_text")))
