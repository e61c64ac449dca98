"""Templates, anomalies, quality, learned stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import anomaly, cache, line_parsers, quality, schema, templates
from .base import DOC_LINES, LOGFMT, SYSLOG, document_lines, logfmt_lines, registry, syslog_lines, table

QUERIES, query = registry()


def skeleton_sql(c: str) -> str:
    s = f"trim(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
    for p, m in ((r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<UUID>"), (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"), (r"\b[0-9A-Fa-f]{8,}\b", "<HEX>"), (r"\"[^\"]*\"|''[^'']*''", '"<STR>"'), (r"\b\d+(?:\.\d+)?\b", "<NUM>"), (r"\s+", " ")):
        s = f"regexp_replace({s}, '{p}', '{m}', 'g')"
    return s


_T = f"t AS (SELECT {skeleton_sql('line')} AS skeleton, line, line_no, file_id FROM lines WHERE regexp_replace(line, '\\s', '', 'g') <> '')"


@query(f"WITH {SYSLOG}, {_T} SELECT substr(sha256(skeleton), 1, 12) AS template_id, any_value(skeleton) AS skeleton, count(*) AS \"count\", min(line_no) AS first_seen, max(line_no) AS last_seen FROM t GROUP BY 1")
def log_templates(spark, d):
    """Templates of the syslog lines with counts and places."""
    return templates.counts(syslog_lines(spark, d))


@query(f"""WITH {LOGFMT}, {_T}, r AS (SELECT *, row_number() OVER (PARTITION BY skeleton ORDER BY file_id, line_no) AS nth FROM t)
SELECT substr(sha256(skeleton), 1, 12) AS template_id, string_agg(substr(line, 1, 1000), '|' ORDER BY nth) AS examples FROM r WHERE nth <= 5 GROUP BY skeleton""")
def template_examples(spark, d):
    """The first five lines of each template."""
    return templates.examples(logfmt_lines(spark, d)).select("template_id", F.array_join("examples", "|").alias("examples"))


@query(f"WITH {DOC_LINES}, {_T} SELECT substr(sha256(skeleton), 1, 12) AS template_id, count(*) AS \"count\" FROM t GROUP BY 1 ORDER BY 2 DESC, max(line_no) DESC, 1 LIMIT 20")
def top_templates(spark, d):
    """The 20 most frequent templates of all document lines (a report of the first 20)."""
    return templates.top(templates.counts(document_lines(spark, d))).select("template_id", "count")


@query(f"WITH {DOC_LINES}, {_T}, n AS (SELECT skeleton, count(*) AS c FROM t GROUP BY 1) SELECT count(*) AS n_templates, max(c) AS max_count, count(*) FILTER (WHERE c >= 100) AS n_frequent FROM n")
def template_statistics(spark, d):
    return templates.stats(templates.counts(document_lines(spark, d)))


def _part_lines(spark, d):
    return table(spark, d, "part").selectExpr("'p' as file_id", "p_partkey as line_no", "concat('part ', p_name, ' of ', p_type, ' size ', p_size, ' from brand ', replace(p_brand, '#', ' nr '), ' on the shelf near the old door by hand') as line")


_PART = "part_lines AS (SELECT p_partkey AS line_no, 'part ' || p_name || ' of ' || p_type || ' size ' || p_size || ' from brand ' || replace(p_brand, '#', ' nr ') || ' on the shelf near the old door by hand' AS line FROM part), pt AS (SELECT " + skeleton_sql("line") + " AS skeleton, min(line_no) AS first_seen, count(*) AS n FROM part_lines GROUP BY 1), pw AS (SELECT substr(sha256(skeleton), 1, 12) AS template_id, first_seen, n, list_distinct(list_filter(string_split(skeleton, ' '), lambda x: x <> '')) AS w FROM pt), pp AS (SELECT a.template_id AS a, b.template_id AS b, a.first_seen AS fa, b.first_seen AS fb, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS score FROM pw a JOIN pw b ON a.template_id < b.template_id)"


@query(f"WITH {_PART} SELECT a, b, round(score, 6) AS score FROM pp WHERE score >= 0.85 - 1e-9")
def similar_templates(spark, d):
    """Pairs of templates that share most words."""
    return templates.similar_pairs(templates.counts(_part_lines(spark, d)), 0.85).select("a", "b", F.round("score", 6).alias("score"))


@query(f"WITH {_PART}, e AS (SELECT a, b, fa, fb FROM pp WHERE score >= 0.85 - 1e-9 UNION ALL SELECT b, a, fb, fa FROM pp WHERE score >= 0.85 - 1e-9), m AS (SELECT a, arg_min(b, (fb, b)) AS merged_into FROM e WHERE (fb, b) < (fa, a) GROUP BY a) SELECT template_id, merged_into FROM pw LEFT JOIN m ON a = template_id")
def merged_templates(spark, d):
    """The earlier template that each one repeats."""
    return templates.merged_into(templates.counts(_part_lines(spark, d)), 0.85)


@query(f"""WITH RECURSIVE {_PART}, ps AS (SELECT skeleton, first_seen, n, substr(sha256(skeleton), 1, 12) AS template_id FROM pt),
  pl AS (SELECT {skeleton_sql("line")} AS skeleton, max(line_no) AS last_seen FROM part_lines GROUP BY 1),
  pr AS (SELECT template_id, row_number() OVER (ORDER BY n DESC, first_seen, template_id) AS rk FROM ps),
  e AS (SELECT a, b FROM pp WHERE score >= 0.85 - 1e-9 UNION ALL SELECT b, a FROM pp WHERE score >= 0.85 - 1e-9),
  reach(node, seen) AS (SELECT template_id, template_id FROM ps UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.seen),
  win AS (SELECT node, min(rk) AS rk FROM reach JOIN pr ON seen = template_id GROUP BY node)
SELECT w.template_id, w.skeleton, CAST(sum(m.n) AS BIGINT) AS count, min(m.first_seen) AS first_seen, max(pl.last_seen) AS last_seen, count(*) AS n_merged
FROM win JOIN ps m ON m.template_id = win.node JOIN pl ON pl.skeleton = m.skeleton JOIN pr ON pr.rk = win.rk JOIN ps w ON w.template_id = pr.template_id GROUP BY ALL""")
def evolved_templates(spark, d):
    """Similar templates as one, counts summed."""
    return templates.evolve(templates.mine(_part_lines(spark, d)), 0.85).drop("examples")


@query(f"WITH {DOC_LINES} SELECT file_id, line_no, CASE WHEN regexp_matches(lower(line), '(?:''\\s+or\\s+1=1|union\\s+select|drop\\s+table)') THEN 'sql' WHEN regexp_matches(lower(line), '(?:<script|javascript:|onerror=)') THEN 'script' WHEN regexp_matches(lower(line), '(?:\\$\\(|`.+`|\\|\\s*sh\\b)') THEN 'shell' END AS kind FROM lines WHERE kind IS NOT NULL")
def attack_lines(spark, d):
    """Document lines with an injection pattern."""
    return document_lines(spark, d).select("file_id", "line_no", S.attack(F.col("line")).alias("kind")).where("kind is not null")


@query("SELECT page_id, CASE WHEN regexp_matches(lower(html), '(?:''\\s+or\\s+1=1|union\\s+select|drop\\s+table)') THEN 'sql' WHEN regexp_matches(lower(html), '(?:<script|javascript:|onerror=)') THEN 'script' END AS kind FROM pages")
def attack_pages(spark, d):
    return table(spark, d, "pages").select("page_id", S.attack(F.col("html")).alias("kind"))


def _units(spark, d):
    e = logfmt_lines(spark, d)
    return e.select("file_id", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("raw"), F.lit(0.8).alias("confidence"), line_parsers.pairs(F.col("line"), r"(\w[\w.\-]*)=(\"[^\"]*\"|\S+)").alias("fields"))


@query(f"""WITH {LOGFMT}, u AS (SELECT *, regexp_matches(lower(line), 'error|fatal|critical|panic') AS hit FROM lines), g AS (SELECT file_id, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS r, min(line_no) FILTER (WHERE hit) AS a, max(line_no) FILTER (WHERE hit) AS b FROM u GROUP BY 1)
SELECT file_id, 'high_error_density' AS type, 'high' AS severity, a AS line_start, b AS line_end, round(least(0.95, 0.4 + r), 6) AS confidence FROM g WHERE r >= 0.3""")
def error_density(spark, d):
    """Users whose log speaks of errors in three of ten lines."""
    return anomaly.error_density(_units(spark, d)).drop("message").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH {LOGFMT}, g AS (SELECT file_id, avg(CASE WHEN regexp_matches(lower(line), 'error|fatal|critical|panic') THEN 1.0 ELSE 0.0 END) AS r FROM lines GROUP BY 1) SELECT CAST(0 AS BIGINT) AS critical, count(*) FILTER (WHERE r >= 0.3) AS high, CAST(0 AS BIGINT) AS medium, CAST(0 AS BIGINT) AS low FROM g")
def severity_summary(spark, d):
    return anomaly.summary(anomaly.report(_units(spark, d)))


def _sparse(spark, d):
    """Documents as a table with nulls in several columns."""
    return table(spark, d, "documents").selectExpr("doc_id", "if(doc_id % 4 = 0, null, lang) as lang", "if(doc_id % 10 != 0, null, source) as source", "substr(text, 1, 20) as raw", "if(doc_id % 9 = 0, 'other', substr(text, 1, 20)) as message")


_SPARSE = "sp AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS lang, CASE WHEN doc_id % 10 <> 0 THEN NULL ELSE source END AS source, substr(text, 1, 20) AS raw, CASE WHEN doc_id % 9 = 0 THEN 'other' ELSE substr(text, 1, 20) END AS message FROM documents)"


@query(f"WITH {_SPARSE} " + " UNION ALL ".join(f"SELECT '{c}' AS column, CAST(round_even(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 3) AS DOUBLE) AS null_ratio FROM sp" for c in ("doc_id", "lang", "source", "raw", "message")))
def column_null_ratios(spark, d):
    return quality.null_ratios(_sparse(spark, d))


@query(f"WITH {_SPARSE}, r AS (SELECT count(*) AS row_count, avg(CASE WHEN lang IS NULL THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN source IS NULL THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN trim(raw) = trim(message) THEN 1.0 ELSE 0.0 END) AS dup FROM sp) SELECT row_count, round((round(a, 3) + round(b, 3)) / 2, 3) AS table_null_ratio, CAST((dup >= 0.8)::INT + (greatest(a, b) > 0.3)::INT AS INT) AS n_warnings, round(least(0.95, least(0.7, (round(a, 3) + round(b, 3)) / 2 + 0.2)), 6) AS penalty FROM r")
def quality_gate(spark, d):
    """The gate's verdict on a table with sparse required columns and messages that repeat their lines."""
    g = quality.evaluate("sparse", _sparse(spark, d), ["lang", "source"])
    row = F.struct(F.lit(g.row_count).cast("long").alias("row_count"), F.lit(g.table_null_ratio).alias("table_null_ratio"), F.lit(len(g.warnings)).alias("n_warnings"), F.lit(round(min(0.95, g.penalty), 6)).alias("penalty"))
    return spark.range(1).select(row.alias("r")).select("r.*")


@query(f"""WITH {LOGFMT}, k AS (SELECT file_id, unnest(['ts', 'user_id', 'level', 'type', 'cents', 'msg']) AS field FROM lines) SELECT file_id, field, CAST(0 AS DOUBLE) AS null_rate FROM k GROUP BY ALL""")
def field_null_rates(spark, d):
    return anomaly.field_null_rates(_units(spark, d)).select("file_id", "field", F.col("null_rate").cast("double").alias("null_rate"))


@query("WITH h AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id DESC) AS rn FROM documents), b AS (SELECT list_distinct(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS w FROM documents ORDER BY doc_id LIMIT 1), s AS (SELECT list_distinct(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda x: x <> '')) AS v FROM h WHERE rn <= 100) SELECT round(1 - avg(len(list_intersect(v, w)) / (len(v) + len(w) - len(list_intersect(v, w)))), 3) AS drift FROM s, b")
def template_drift(spark, d):
    """How far the last hundred texts (the measure's own window) are from the first."""
    t = table(spark, d, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("skeleton"))
    return templates.drift(t, t.orderBy("line_no").first()["skeleton"])


def _store(spark, d):
    return table(spark, d, "orders").selectExpr("concat('k', o_orderkey) as schema_key", "cast(o_custkey as string) as fingerprint", "o_orderpriority as domain", "o_orderstatus as detected_format", "round(0.5 + (o_orderkey % 50) / 100.0, 2) as format_confidence", "o_orderkey % 7 as successes", "o_orderkey % 3 as failures", "o_orderkey % 11 as access_count", "cast(o_orderdate as timestamp) as updated_at")


_STORE = "st AS (SELECT 'k' || o_orderkey AS schema_key, CAST(o_custkey AS VARCHAR) AS fingerprint, o_orderpriority AS domain, o_orderstatus AS detected_format, round(0.5 + (o_orderkey % 50) / 100.0, 2) AS conf, o_orderkey % 7 AS s, o_orderkey % 3 AS f, o_orderkey % 11 AS ac, CASE WHEN o_orderkey % 7 + o_orderkey % 3 = 0 THEN 0.5 ELSE (o_orderkey % 7) / (o_orderkey % 7 + o_orderkey % 3) END AS health, o_orderdate FROM orders)"


@query(f"WITH {_STORE}, r AS (SELECT *, row_number() OVER (PARTITION BY fingerprint, domain ORDER BY conf DESC, health DESC, ac DESC, schema_key) AS nth FROM st WHERE conf >= 0.85) SELECT fingerprint, domain, schema_key FROM r WHERE nth = 1")
def cache_by_fingerprint(spark, d):
    """The best known schema of each fingerprint and domain."""
    s = _store(spark, d)
    return cache.by_fingerprint(s, s).select("fingerprint", "domain", "schema_key")


@query(f"WITH {_STORE} SELECT count(*) AS n_entries, count(*) FILTER (WHERE o_orderdate < TIMESTAMP '2000-01-01' - INTERVAL 30 DAY) AS n_expired, count(*) FILTER (WHERE health > 0.7) AS n_healthy, CAST(sum(ac) AS BIGINT) AS n_accesses FROM st")
def cache_statistics(spark, d):
    return cache.stats(_store(spark, d), F.lit("2000-01-01").cast("timestamp"))


@query(f"WITH {_STORE} SELECT schema_key FROM st WHERE detected_format = 'O' ORDER BY health DESC, ac DESC, schema_key LIMIT 5")
def cache_by_format(spark, d):
    """The five healthiest schemas of a format (a top five)."""
    return cache.by_format(_store(spark, d), "O").select("schema_key")


@query("""WITH e AS (SELECT md5(concat_ws(':', o_orderstatus, o_orderpriority, 'default', CAST(o_custkey AS VARCHAR), 'a,b')) AS signature, o_orderstatus AS format, o_orderpriority AS domain, (o_orderkey % 50) / 100.0 AS confidence FROM orders),
g AS (SELECT signature, any_value(format) AS format, any_value(domain) AS domain, max(confidence) AS confidence, count(*) AS usage FROM e GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY format, domain ORDER BY usage DESC, confidence DESC, signature) AS nth FROM g) SELECT signature, format, domain, CAST(confidence AS DOUBLE) AS confidence, usage FROM r WHERE nth <= 10""")
def few_shot_store(spark, d):
    """The ten most used examples of each format and domain (the store's own bound)."""
    o = table(spark, d, "orders")
    sig = cache.few_shot_signature(F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("default"), F.col("o_custkey").cast("string"), F.array(F.lit("b"), F.lit("a")))
    e = o.select(sig.alias("signature"), F.col("o_orderstatus").alias("format"), F.col("o_orderpriority").alias("domain"), (F.col("o_orderkey") % 50 / 100.0).cast("double").alias("confidence"), F.lit(1).cast("long").alias("usage"))
    return cache.add_few_shots(e.limit(0), e)


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events), l AS (SELECT 'user_id=' || user_id || CASE WHEN event_type = 'error' THEN ' error code: ' || event_id % 7 ELSE '' END || CASE event_type WHEN 'view' THEN '' ELSE ' cents=5' END AS line FROM e WHERE nth <= 100),
r AS (SELECT 0 AS round, unnest(['user_id', 'error_code', 'cents', 'never']) AS name UNION ALL SELECT 1, unnest(['user_id', 'error_code', 'cents']) UNION ALL SELECT 2, unnest(['user_id', 'cents']))
SELECT round, name, round_even(avg(CASE WHEN contains(line, replace(name, '_', ' ') || ':') OR contains(line, name || '=') THEN 0.0 ELSE 1.0 END), 3) AS null_rate FROM r, l GROUP BY ALL""")
def refined_null_rates(spark, d):
    """Null rates of each round of refining on the heads of all logs (100 lines of each, the loop's own sample): columns that stay empty are given up one by one."""
    line = "concat('user_id=', user_id, if(event_type = 'error', concat(' error code: ', event_id % 7), ''), if(event_type = 'view', '', ' cents=5'))"
    lines = table(spark, d, "events").selectExpr("cast(user_id as string) as file_id", "event_id + 1 as line_no", f"{line} as line")

    def propose(shown, columns, high):
        if not columns:
            return [schema.Column(n, "TEXT") for n in ("user_id", "error_code", "cents", "never")]
        worst = max(high, key=lambda n: (high[n], n))
        return [c for c in columns if c.name != worst]

    rounds = schema.refined(lines, propose).rates
    return spark.createDataFrame([(k, n, r) for k, found in enumerate(rounds) for n, r in found.items()], "round int, name string, null_rate double")


_ODD_UNITS = """u AS (SELECT CAST(user_id AS VARCHAR) AS file_id, event_id + 1 AS n, CASE WHEN event_id % 97 = 0 THEN 'x <script src=y>' ELSE 'seen ' || event_type END AS raw,
  (event_id + user_id) % 3 = 0 AS unsure, event_type IN ('error', 'purchase') AS bad, event_id % 40 = 0 AS rare, event_type = 'view' AS wide FROM events)"""


def _odd_units(spark, d):
    """Units of every kind of trouble: unsure ones, payloads, fields that are mostly absent, errors."""
    bad = F.col("event_type").isin("error", "purchase")
    fields = F.map_filter(F.create_map(F.lit("message"), F.col("event_type"), F.lit("log_level"), F.when(bad, "ERROR"), F.lit("rare"), F.when(F.col("event_id") % 40 == 0, "r"), F.lit("wide"), F.when(F.col("event_type") == "view", "w")), lambda k, v: v.isNotNull())
    raw = F.when(F.col("event_id") % 97 == 0, "x <script src=y>").otherwise(F.concat(F.lit("seen "), "event_type"))
    sure = F.when((F.col("event_id") + F.col("user_id")) % 3 == 0, 0.3).otherwise(0.8)
    n = F.col("event_id") + 1
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("file_id"), n.alias("start_line"), n.alias("end_line"), raw.alias("raw"), sure.alias("confidence"), fields.alias("fields"))


@query(f"""WITH {_ODD_UNITS}, g AS (SELECT file_id, count(*) AS k, min(n) AS a, max(n) AS b FROM u GROUP BY 1),
f AS (SELECT file_id, field, count(*) AS held FROM (SELECT file_id, 'message' AS field FROM u UNION ALL SELECT file_id, 'log_level' FROM u WHERE bad UNION ALL SELECT file_id, 'rare' FROM u WHERE rare UNION ALL SELECT file_id, 'wide' FROM u WHERE wide) GROUP BY ALL)
SELECT file_id, field, CAST(round_even(1 - held / k, 3) AS DOUBLE) AS null_rate, a AS start_line, b AS end_line FROM f JOIN g USING (file_id)""")
def sparse_field_null_rates(spark, d):
    """Null rates of fields that every, some and few units of a file have."""
    return anomaly.field_null_rates(_odd_units(spark, d))


@query(f"""WITH {_ODD_UNITS}, g AS (SELECT file_id, count(*) AS k, min(n) AS a, max(n) AS b, avg(CASE WHEN unsure THEN 1.0 ELSE 0.0 END) AS drift, min(n) FILTER (WHERE unsure) AS da, max(n) FILTER (WHERE unsure) AS db,
  avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) AS errors, min(n) FILTER (WHERE bad) AS ea, max(n) FILTER (WHERE bad) AS eb, 1 - count(*) FILTER (WHERE rare) / count(*) AS r, 1 - count(*) FILTER (WHERE wide) / count(*) AS w, 1 - count(*) FILTER (WHERE bad) / count(*) AS l FROM u GROUP BY 1),
x AS (SELECT file_id, 'format_drift' AS type, 'high' AS severity, da AS line_start, db AS line_end, least(0.95, 0.5 + drift) AS confidence FROM g WHERE drift > 0.25
UNION ALL SELECT file_id, 'security_pattern', 'critical', n, n, 0.9 FROM u WHERE contains(raw, '<script')
UNION ALL SELECT file_id, 'schema_breakage', 'medium', a, b, least(0.95, round_even(v, 3)) FROM (SELECT file_id, a, b, unnest([r, w, l]) AS v FROM g) WHERE round_even(v, 3) >= 0.9 AND v < 1
UNION ALL SELECT file_id, 'high_error_density', 'high', ea, eb, least(0.95, 0.4 + errors) FROM g WHERE errors >= 0.3)
SELECT file_id, type, severity, line_start, line_end, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM x""")
def anomaly_findings(spark, d):
    """All kinds of findings on every file."""
    return anomaly.report(_odd_units(spark, d)).select("file_id", "type", "severity", "line_start", "line_end", F.round("confidence", 6).alias("confidence"))
