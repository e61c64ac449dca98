"""Parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import line_parsers, schema, structured
from .base import ACCESS, DOC_LINES, JSON_TEXT, LOGFMT, SYSLOG, TRACE, access_lines, document_lines, json_text_lines, logfmt_lines, registry, syslog_lines, table, trace_lines

QUERIES, query = registry()

_LEVELS = """CASE WHEN regexp_matches(lower({0}), 'critical|panic') THEN 'CRITICAL' WHEN lower({0}) LIKE '%fatal%' THEN 'FATAL'
    WHEN lower({0}) LIKE '%error%' THEN 'ERROR' WHEN lower({0}) LIKE '%warn%' THEN 'WARNING' WHEN lower({0}) LIKE '%debug%' THEN 'DEBUG'
    WHEN lower({0}) LIKE '%trace%' THEN 'TRACE' ELSE 'INFO' END"""


@query(f"WITH {LOGFMT} SELECT {_LEVELS.format('line')} AS log_level, count(*) AS n FROM lines GROUP BY 1")
def logfmt_levels(spark, d):
    """logfmt lines, parsed, by level."""
    return line_parsers.logfmt(logfmt_lines(spark, d)).groupBy("log_level").agg(F.count("*").alias("n"))


@query(f"""WITH {LOGFMT} SELECT file_id, line_no, regexp_extract(line, 'ts=(\\S+)', 1) AS ts, regexp_extract(line, '" user_id=(\\d+)$', 1) AS user_id,
  regexp_extract(line, 'type=(\\S+)', 1) AS type, CAST(regexp_extract(line, 'cents=(\\d+)', 1) AS BIGINT) AS cents, regexp_extract(line, 'msg="([^"]*)"', 1) AS msg FROM lines""")
def logfmt_parse(spark, d):
    """The fields of each line; of equal keys the last stays."""
    f = F.col("fields")
    return line_parsers.logfmt(logfmt_lines(spark, d)).select("file_id", "line_no", f["ts"].alias("ts"), f["user_id"].alias("user_id"), f["type"].alias("type"), f["cents"].cast("long").alias("cents"), f["msg"].alias("msg"))


@query(f"""WITH {LOGFMT}, p AS (SELECT unnest(regexp_extract_all(line, '(\\w[\\w.\\-]*)=("[^"]*"|\\S+)', 1)) AS key, file_id, line_no FROM lines)
SELECT key, count(*) AS n FROM (SELECT DISTINCT key, file_id, line_no FROM p) GROUP BY key""")
def key_value_pairs(spark, d):
    """How many lines carry each key."""
    return line_parsers.key_value(logfmt_lines(spark, d).withColumn("line", F.regexp_replace("line", r"(\d\d):(\d\d):(\d\d)", "$1.$2.$3"))).select(F.explode("fields").alias("key", "value")).groupBy("key").agg(F.count("*").alias("n"))


_SYS = r"(?i)^(?:<(\d{1,3})>)?((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+([\w.\-/]+)(?:\[(\d+)\])?:\s*(.*)$"
_g = lambda k: f"regexp_extract(line, '{_SYS}', {k})"


@query(f"""WITH {SYSLOG} SELECT file_id, line_no, {_g(2)} AS timestamp, {_g(3)} AS host, {_g(4)} AS process, CAST({_g(5)} AS BIGINT) AS pid, {_g(6)} AS message,
  {_LEVELS.format(_g(6))} AS log_level, CAST({_g(1)} AS BIGINT) AS syslog_pri, CAST({_g(1)} AS BIGINT) // 8 AS syslog_facility, CAST({_g(1)} AS BIGINT) % 8 AS syslog_severity FROM lines""")
def syslog_parse(spark, d):
    return line_parsers.syslog(syslog_lines(spark, d)).drop("filename", "raw")


@query(f"""WITH {SYSLOG} SELECT file_id, line_no, list_extract(['EMERGENCY', 'ALERT', 'CRITICAL', 'ERROR', 'WARNING', 'NOTICE', 'INFO', 'DEBUG'], CAST(CAST({_g(1)} AS BIGINT) % 8 + 1 AS BIGINT)) AS log_level,
  regexp_extract({_g(6)}, '^([A-Z][A-Z0-9_]+)', 1) AS event_type, regexp_extract(line, 'cents=(\\d+)', 1) AS cents, regexp_extract(line, 'state=(\\S+)', 1) AS state FROM lines""")
def syslog_event_fields(spark, d):
    """The event's name and fields in a syslog message, the level of its priority."""
    f = F.col("fields")
    return line_parsers.syslog_events(syslog_lines(spark, d)).select("file_id", "line_no", "log_level", "event_type", f["cents"].alias("cents"), f["state"].alias("state"))


_ACC = r'^(\S+)\s+(\S+)\s+(\S+)\s+\[([^\]]+)\]\s+"([^"]*)"\s+(\d{3})\s+(\S+)(?:\s+"([^"]*)"\s+"([^"]*)")?'
_a = lambda k: f"nullif(regexp_extract(line, '{_ACC}', {k}), '')"
_STATUS_LEVEL = "CASE WHEN {0} >= 500 THEN 'ERROR' WHEN {0} >= 400 THEN 'WARNING' ELSE 'INFO' END"


@query(f"""WITH {ACCESS} SELECT file_id, line_no, {_a(1)} AS ip, {_a(2)} AS ident, {_a(3)} AS authuser, {_a(4)} AS timestamp, {_a(5)} AS request, CAST({_a(6)} AS INT) AS status, {_a(7)} AS body_bytes, {_a(8)} AS referer, {_a(9)} AS user_agent,
  {_STATUS_LEVEL.format(f'CAST({_a(6)} AS INT)')} AS log_level FROM lines""")
def access_parse(spark, d):
    return line_parsers.access(access_lines(spark, d)).drop("filename", "raw", "message")


@query(f"WITH {ACCESS}, p AS (SELECT CAST({_a(6)} AS INT) AS status FROM lines) SELECT {_STATUS_LEVEL.format('status')} AS log_level, status, count(*) AS n FROM p GROUP BY ALL")
def access_levels(spark, d):
    return line_parsers.access(access_lines(spark, d)).groupBy("log_level", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {JSON_TEXT} SELECT file_id, line_no, filename AS source_file, json_extract_string(line, '$.id') AS id, json_extract_string(line, '$.payload.k') AS payload_k,
  json_extract_string(line, '$.who.user') AS who_user, json_extract_string(line, '$.who.tags[0]') || ',' || json_extract_string(line, '$.who.tags[1]') AS who_tags FROM lines WHERE json_valid(line)""")
def json_lines_flatten(spark, d):
    """Nested JSON lines as flat columns."""
    f = F.col("fields")
    return structured.json_lines(json_text_lines(spark, d)).select("file_id", F.col("row_no").alias("line_no"), *[f[c].alias(c) for c in ("source_file", "id", "payload_k", "who_user", "who_tags")])


@query(f"WITH {JSON_TEXT} SELECT file_id, filename, line_no, 'line ' || line_no || ': invalid JSON object' AS warning FROM lines WHERE NOT json_valid(line)")
def json_invalid_lines(spark, d):
    return structured.invalid_json(json_text_lines(spark, d))


@query("""SELECT CAST(event_id AS VARCHAR) AS document_id, CAST(i AS VARCHAR) AS item_index, CAST(i * 10 + event_id % 7 AS VARCHAR) AS seq FROM (SELECT event_id, unnest(range(1, CAST(event_id % 4 + 1 AS BIGINT))) AS i FROM events)""")
def json_child_tables(spark, d):
    """Lists of objects in a document as a child table keyed to it."""
    steps = "array_join(transform(if(event_id % 4 = 0, array(), sequence(1, event_id % 4)), i -> concat('{\"seq\": ', i * 10 + event_id % 7, '}')), ',')"
    files = table(spark, d, "events").selectExpr("cast(event_id as string) as file_id", "concat(event_id, '.json') as filename", f"concat('{{\"run_id\": \"', event_id, '\", \"steps\": [', {steps}, ']}}') as content")
    f = F.col("fields")
    return structured.json_documents(files).where("logical_name = 'steps'").select(f["document_id"].alias("document_id"), f["item_index"].alias("item_index"), f["seq"].alias("seq"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS file_id, CAST(o_orderkey AS BIGINT) AS key, o_orderstatus AS status, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS price, o_orderpriority AS note FROM orders""")
def csv_parse(spark, d):
    """Delimited files, one for each customer: delimiter and header sniffed, cells named."""
    o = table(spark, d, "orders").selectExpr("cast(o_custkey as string) as file_id", "concat(o_custkey, '.csv') as filename", "o_orderkey + 2 as line_no", "concat(o_orderkey, ';', o_orderstatus, ';', cast(round(o_totalprice) as bigint), ';', o_orderpriority) as line")
    heads = o.select("file_id", "filename").distinct().withColumn("line_no", F.lit(1).cast("long")).withColumn("line", F.lit("Order Key;Status;Price;Note"))
    f = F.col("fields")
    return structured.delimited(heads.unionByName(o)).select("file_id", f["order_key"].cast("long").alias("key"), f["status"].alias("status"), f["price"].alias("price"), f["note"].alias("note"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS recipe_id, CAST(l_linenumber AS VARCHAR) AS step_seq, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS duration_s FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def xml_recipe_steps(spark, d):
    """Orders as recipe documents, their lines as steps, parsed back into the steps table."""
    step = F.concat(F.lit('<step seq="'), "l_linenumber", F.lit('" name="s" duration_s="'), F.col("l_quantity").cast("long"), F.lit('"/>'))
    body = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(step), "").alias("steps"))
    files = table(spark, d, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").cast("string").alias("file_id"), F.concat("o_orderkey", F.lit(".xml")).alias("filename"), F.concat(F.lit('<recipe name="'), "o_orderkey", F.lit('" version="1">'), "steps", F.lit("</recipe>")).alias("content"))
    f = F.col("fields")
    return structured.xml_documents(files).where("logical_name = 'recipe_steps'").select(F.replace(f["recipe_id"], F.lit(":1"), F.lit("")).alias("recipe_id"), f["step_seq"].alias("step_seq"), f["duration_s"].alias("duration_s"))


_KEYS = "CAST(o_orderkey AS VARCHAR) || ':1' AS recipe_id"
_STEP = "CAST(l_linenumber AS VARCHAR) AS step_seq"


@query(f"""SELECT 'recipe' AS logical_name, {_KEYS}, NULL AS step_seq, CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS a, o_orderstatus AS b FROM orders
UNION ALL SELECT 'recipe_steps', {_KEYS}, {_STEP}, 's' || l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), NULL FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'recipe_setpoints', {_KEYS}, {_STEP}, 'part', CAST(l_partkey AS VARCHAR), NULL FROM orders JOIN lineitem ON o_orderkey = l_orderkey
UNION ALL SELECT 'recipe_interlocks', {_KEYS}, {_STEP}, l_returnflag, 'true', NULL FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'
UNION ALL SELECT 'recipe_tolerances', {_KEYS}, {_STEP}, 'supplier', CAST(l_suppkey AS VARCHAR), CAST(l_suppkey + 2 AS VARCHAR) FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def xml_recipe_tables(spark, d):
    """All five tables of orders as recipe documents: the head, and of each step its setpoint, interlock and tolerance."""
    inner = "concat('<setpoint name=\"part\" value=\"', l_partkey, '\"/>', if(l_returnflag = 'R', '<interlock name=\"R\" required=\"true\"/>', ''), '<tolerance name=\"supplier\" low=\"', l_suppkey, '\" high=\"', l_suppkey + 2, '\"/>')"
    step = F.expr(f"concat('<step seq=\"', l_linenumber, '\" name=\"s', l_linenumber, '\" duration_s=\"', cast(l_quantity as bigint), '\">', {inner}, '</step>')")
    body = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(step), "").alias("steps"))
    o = table(spark, d, "orders").join(body, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    head = "concat('<recipe name=\"', o_orderkey, '\" version=\"1\" tool=\"', o_orderpriority, '\" chamber=\"', o_orderstatus, '\">', coalesce(steps, ''), '</recipe>')"
    files = o.selectExpr("cast(o_orderkey as string) as file_id", "concat(o_orderkey, '.xml') as filename", f"{head} as content")
    f = F.col("fields")
    told = lambda *keys: F.coalesce(*[f[k] for k in keys])
    return structured.xml_documents(files).select("logical_name", f["recipe_id"].alias("recipe_id"), f["step_seq"].alias("step_seq"), told("recipe_name", "step_name", "setpoint_name", "interlock_name", "tolerance_name").alias("name"), told("tool", "duration_s", "setpoint_value", "interlock_required", "tolerance_low").alias("a"), told("chamber", "tolerance_high").alias("b"))


@query(f"WITH {DOC_LINES}, p AS (SELECT {_LEVELS.format('line')} AS log_level FROM lines WHERE trim(line) <> '') SELECT log_level, count(*) AS n FROM p GROUP BY 1")
def plain_line_levels(spark, d):
    """Levels of the plain lines of all documents."""
    return line_parsers.plain(document_lines(spark, d)).groupBy("log_level").agg(F.count("*").alias("n"))


@query(f"""WITH {TRACE}, f AS (SELECT *, trim(line) = '' AS blank, lag(trim(line) = '') OVER w AS before, regexp_matches(line, '^(?:\\s+at\\s|Caused by:|\\.{{3}}\\s*\\d+\\s*more|\\s{{4,}}\\S|\\t\\S)') AS more FROM lines WINDOW w AS (PARTITION BY file_id ORDER BY line_no)),
g AS (SELECT *, sum(CASE WHEN NOT blank AND NOT (more AND coalesce(NOT before, false)) THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no) AS block FROM f)
SELECT file_id, min(line_no) AS start_line, max(line_no) AS end_line, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY line_no) AS raw FROM g WHERE NOT blank GROUP BY file_id, block""")
def multiline_blocks(spark, d):
    """Stack traces with their frames as one record."""
    return line_parsers.blocks(trace_lines(spark, d)).drop("filename")


_HEXES = "SELECT CAST(c_nationkey AS VARCHAR) AS file_id, c_custkey AS line_no, lower(hex(c_name)) AS h FROM customer"


@query(f"""WITH x AS ({_HEXES}) SELECT file_id, line_no, CAST(coalesce(sum(length(h) // 2) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", h AS hex_bytes,
  decode(unhex(h)) AS ascii_repr FROM x WHERE line_no % 5 <> 0""")
def hexdump_offsets(spark, d):
    """Dump lines with running offsets; lines that are no dump don't count."""
    h = F.lower(F.hex(F.col("c_name")))
    line = F.when(F.col("c_custkey") % 5 == 0, "no dump").otherwise(F.concat(F.lit("00000000  "), F.rtrim(F.regexp_replace(h, "(..)", "$1 "))))
    lines = table(spark, d, "customer").select(F.col("c_nationkey").cast("string").alias("file_id"), F.lit("x.hex").alias("filename"), F.col("c_custkey").alias("line_no"), line.alias("line"))
    return line_parsers.hex_dump(lines).select("file_id", "line_no", "offset", "hex_bytes", "ascii_repr")


@query(r"""WITH r AS (SELECT doc_id, regexp_extract_all(text, '[\x20-\x7e]{4,}') AS runs FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS file_id, len(runs) AS n_strings, sum_len AS n_chars FROM (SELECT *, list_sum(list_transform(runs, lambda x: length(x))) AS sum_len FROM r) WHERE len(runs) > 0""")
def printable_strings(spark, d):
    """Printable runs of each document, all of them."""
    files = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("filename"), F.col("text").alias("content"))
    return line_parsers.printable_strings(files).groupBy("file_id").agg(F.count("*").alias("n_strings"), F.sum(F.length("text")).alias("n_chars"))


@query(f"""WITH {LOGFMT}, k AS (SELECT 'cents' AS name, regexp_extract(line, 'cents=(\\S+)', 1) AS v FROM lines UNION ALL SELECT 'ts', regexp_extract(line, 'ts=(\\S+)', 1) FROM lines UNION ALL SELECT 'user_id', '1' FROM lines
  UNION ALL SELECT 'level', regexp_extract(line, 'level=(\\S+)', 1) FROM lines UNION ALL SELECT 'type', regexp_extract(line, 'type=(\\S+)', 1) FROM lines UNION ALL SELECT 'msg', 'text' FROM lines)
SELECT name, CASE max(CASE WHEN regexp_matches(v, '^[+-]?\\d+$') THEN 2 ELSE 5 END) WHEN 2 THEN 'INTEGER' ELSE 'TEXT' END AS sql_type, count(*) AS n_present FROM k GROUP BY name""")
def schema_inference(spark, d):
    """Column names and types that the fields of all lines ask for."""
    r = line_parsers.logfmt(logfmt_lines(spark, d)).withColumn("logical_name", F.lit("logfmt"))
    return schema.infer(r).select("name", "sql_type", "n_present")


_W = r"(SELECT unnest(regexp_extract_all(text, '\S+')) AS w FROM documents)"
_B = r"regexp_replace(w, '[|,;:)\]}]+$', '')"


@query(rf"""SELECT CASE WHEN lower(w) IN ('null', 'none', 'nan', 'n/a') THEN 'null' WHEN lower(w) IN ('true', 'false') THEN 'boolean' WHEN lower(w) IN ('pass', 'warn', 'warning', 'fail', 'error', 'ok') THEN 'text'
  WHEN regexp_matches({_B}, '^[+-]?\d+\.\d+$') THEN 'real' WHEN regexp_matches({_B}, '^[+-]?\d+$') THEN 'integer' ELSE 'text' END AS kind, count(*) AS n FROM {_W} GROUP BY 1""")
def coerce_kinds(spark, d):
    """What types the words of all documents have."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("w"))
    return words.groupBy(S.coerce(F.col("w"))["kind"].alias("kind")).agg(F.count("*").alias("n"))


_SAN = r"trim(regexp_replace(regexp_replace(trim(t), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g'), '_')"


@query(rf"""WITH x AS (SELECT p_partkey, p_partkey % 3 || ' ' || p_name || '(' || p_brand || ')' || CASE WHEN p_partkey % 4 = 0 THEN repeat(' long-name', 8) ELSE '' END AS t FROM part),
y AS (SELECT p_partkey, lower('field_' || {_SAN}) AS s FROM x)
SELECT p_partkey, CASE WHEN length(s) <= 63 THEN s ELSE rtrim(substr(s, 1, 54), '_') || '_' || substr(md5(s), 1, 8) END AS name FROM y""")
def sanitize_names(spark, d):
    """Column names from part descriptions."""
    t = F.expr("concat(p_partkey % 3, ' ', p_name, '(', p_brand, ')', if(p_partkey % 4 = 0, repeat(' long-name', 8), ''))")
    return table(spark, d, "part").select("p_partkey", S.sanitize_identifier(t).alias("name"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 3 WHEN 2 THEN '+08:00' ELSE '+00:00' END AS iso FROM events")
def iso_timestamps(spark, d):
    """Timestamps as text, Z and none as +00:00, other offsets kept."""
    t = F.expr("concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss'), case event_id % 3 when 0 then 'Z' when 2 then '+0800' else '' end)")
    return table(spark, d, "events").select("event_id", S.iso_timestamp(t).alias("iso"))
