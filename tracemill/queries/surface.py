"""What users ask of tables: filters, pages, summaries, guarded SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import search_index, tables
from ..plans import sql
from ..plans.catalog import Catalog
from ..sources.shared import shared_dir, written
from .base import registry, table

QUERIES, query = registry()


def _events(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") as timestamp", "user_id", "case event_type when 'error' then 'error' when 'view' then 'WARNING' when 'click' then ' warn ' else 'INFO' end as level", "event_type", "props")


@query("SELECT event_id FROM events WHERE contains(lower(props), '\"k\": 7') OR contains(lower(event_type), '\"k\": 7')")
def filter_search(spark, d):
    """Rows that hold a text anywhere."""
    return tables.search(_events(spark, d), '\\"K\\": 7').select("event_id")


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click', 'error')")
def filter_levels(spark, d):
    return tables.with_levels(_events(spark, d), ["warning", "ERROR"]).select("event_id")


@query("SELECT event_id FROM events WHERE contains(event_type, 'ic') AND contains(CAST(user_id AS VARCHAR), '4')")
def filter_fields(spark, d):
    return tables.with_fields(_events(spark, d), {"event_type": "IC", "user_id": "4", "absent": " "}).select("event_id")


@query("SELECT event_id FROM events WHERE date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-12 12:00:00'")
def filter_time_range(spark, d):
    return tables.within(_events(spark, d), "2024-01-05T00:00:00", "2024-01-12T12:00:00+00:00").select("event_id")


@query("SELECT event_id, user_id FROM events WHERE event_type IN ('view', 'click') AND contains(CAST(user_id AS VARCHAR), '1') AND date_trunc('second', ts) >= TIMESTAMP '2024-01-10 00:00:00'")
def filter_combined(spark, d):
    return tables.filtered(_events(spark, d), "", ["WARN"], {"user_id": "1"}, "2024-01-10 00:00:00", "never").select("event_id", "user_id")


@query("SELECT event_id, coalesce(CAST(user_id AS VARCHAR), '') AS user_id, coalesce(props, '') AS props FROM events")
def export_rows(spark, d):
    """Cells as an export writes them, of every row."""
    return tables.export_rows(_events(spark, d).select("event_id", "user_id", "props")).withColumn("event_id", F.col("event_id").cast("long"))


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def value_distribution(spark, d):
    return tables.value_distribution(table(spark, d, "events"), "event_type")


@query("SELECT CAST(user_id AS VARCHAR) AS value, count(*) AS n FROM events GROUP BY 1")
def facet_counts(spark, d):
    return tables.facets(table(spark, d, "events"), "user_id")


@query("SELECT strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last, count(*) AS n FROM events")
def time_range(spark, d):
    return tables.time_range(_events(spark, d), "timestamp")


@query("SELECT round(avg(value), 6) AS value, round(avg(CAST(user_id AS DOUBLE)), 6) AS user_id, CAST(NULL AS DOUBLE) AS event_type FROM events")
def casted_averages(spark, d):
    a = tables.casted_averages(table(spark, d, "events"), ["value", "user_id", "event_type"])
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


@query("SELECT CASE WHEN event_id % 5 = 0 THEN '' ELSE event_type END AS x, CASE WHEN event_id % 6 = 0 THEN 0 ELSE value END AS y FROM events")
def chart_points(spark, d):
    e = table(spark, d, "events").selectExpr("if(event_id % 5 = 0, null, event_type) as x", "case when event_id % 6 = 0 then 'n/a' else cast(value as string) end as y")
    return tables.chart(e, "x", "y")


@query("SELECT * FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey, s_name, s_nationkey LIMIT 20 OFFSET 20")
def sorted_page(spark, d):
    """The second page of a table in order (20 rows are the page)."""
    return tables.page(table(spark, d, "supplier"), "s_acctbal", True, 20, 1)


@query("SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def equality_query(spark, d):
    return tables.equal_to(table(spark, d, "customer"), {"c_mktsegment": "BUILDING", "c_nationkey": 3}, limit=2**31 - 1)


_STATUS = {"F": "completed", "O": "processing", "P": "failed"}


def _processes(spark, d):
    return table(spark, d, "orders").selectExpr("o_orderkey as process_id", "o_custkey as file_id", "o_custkey % 25 as group_id", "case o_orderstatus when 'F' then 'completed' when 'O' then 'processing' else 'failed' end as status", "cast(o_totalprice as bigint) as row_count", "o_orderdate as updated_at", "o_orderkey % 4 = 0 as queued")


@query("SELECT CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'processing' ELSE 'failed' END AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, d):
    return tables.status_counts(_processes(spark, d))


@query("""SELECT (SELECT count(*) FROM nation) AS n_groups, (SELECT count(*) FROM customer) AS n_files, CAST(0 AS BIGINT) AS n_queued, count(*) FILTER (WHERE o_orderstatus = 'O') AS n_processing, count(*) FILTER (WHERE o_orderstatus = 'F') AS n_completed,
  count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS n_failed, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(trunc(o_totalprice) AS BIGINT) ELSE 0 END) AS BIGINT) AS total_rows FROM orders""")
def dashboard(spark, d):
    groups = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("group_id"))
    return tables.dashboard(groups, table(spark, d, "customer"), _processes(spark, d))


@query("SELECT o_custkey AS file_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS process_id FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def latest_per_file(spark, d):
    return tables.latest_completed(_processes(spark, d)).select("file_id", "process_id")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def orphan_assets(spark, d):
    return tables.orphans(table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT o_custkey AS file_id, CASE WHEN count(*) FILTER (WHERE o_orderkey % 4 = 0) = 0 THEN 'failed' WHEN count(*) FILTER (WHERE o_orderkey % 4 = 0) = count(*) THEN 'queued' ELSE 'partial' END AS status FROM orders GROUP BY 1")
def batch_statuses(spark, d):
    return tables.batch_status(_processes(spark, d), "file_id")


@query("SELECT c_mktsegment AS source, count(*) AS n_tables, CAST(sum(c_nationkey) AS BIGINT) AS n_rows FROM customer GROUP BY 1")
def tables_by_source(spark, d):
    t = table(spark, d, "customer").select(F.col("c_name").alias("table_name"), F.col("c_mktsegment").alias("source"), F.col("c_nationkey").cast("long").alias("row_count"))
    return tables.by_source(t)


@query("SELECT event_id AS at, event_type || CASE WHEN row_number() OVER w > 1 THEN ' (' || row_number() OVER w || ')' ELSE '' END AS label FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)")
def numbered_warnings(spark, d):
    w = table(spark, d, "events").select(F.col("user_id").alias("process_id"), F.col("event_type").alias("warning"), F.col("event_id").alias("at"))
    return tables.numbered(w).select("at", "label")


@query("""WITH g AS (SELECT DISTINCT event_type AS field, CAST(user_id AS VARCHAR) AS value FROM events WHERE event_id % 2 = 0), f AS (SELECT DISTINCT event_type AS field, CAST(user_id AS VARCHAR) AS value FROM events WHERE event_id % 3 = 0),
n AS (SELECT (SELECT count(*) FROM g) AS n_gold, (SELECT count(*) FROM f) AS n_found, (SELECT count(*) FROM g JOIN f USING (field, value)) AS n_both)
SELECT n_gold, n_found, n_both, round(n_both / n_found, 6) AS precision, round(n_both / n_gold, 6) AS recall, round(2 * (n_both / n_found) * (n_both / n_gold) / (n_both / n_found + n_both / n_gold), 6) AS f1 FROM n""")
def field_scores(spark, d):
    """Precision and recall of field values against a gold set."""
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("field"), F.col("user_id").alias("value"))
    return tables.field_scores(e.where("event_id % 2 = 0"), e.where("event_id % 3 = 0"))


@query("SELECT conv_id, turn, CASE WHEN upper(trim(role)) = 'WARNING' THEN 'WARN' ELSE upper(trim(role)) END AS level FROM conversations")
def normalized_levels(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", S.normalize_level(F.col("role")).alias("level"))


@query("SELECT c_mktsegment AS segment, count(*) AS n, round(avg(c_acctbal), 4) AS balance FROM customer WHERE c_acctbal > 0 GROUP BY 1 ORDER BY 1")
def guarded_sql(spark, d):
    """A read-only query in another database's dialect, through the guard."""
    table(spark, d, "customer").createOrReplaceTempView("guarded_customer")
    text = 'SELECT "c_mktsegment" AS segment, count(*) AS n, round(avg(CAST("c_acctbal" AS REAL)), 4) AS balance FROM "guarded_customer" WHERE "c_acctbal" > 0 GROUP BY "c_mktsegment" ORDER BY 1;'
    return sql.query(spark, text, {"guarded_customer"})


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'In progress' ELSE CAST(date_diff('second', o_orderdate, o_orderdate + INTERVAL 1 SECOND * (o_orderkey % 97)) AS VARCHAR) || 's' END AS label FROM orders")
def duration_labels(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    end = F.timestamp_add("SECOND", (F.col("o_orderkey") % 97).cast("int"), "o_orderdate")
    return o.select("o_orderkey", S.duration_label(F.col("o_orderdate"), end, F.when(F.col("o_orderstatus") == "O", "processing").otherwise("completed")).alias("label"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || text WHEN turn % 3 = 1 THEN text ELSE role END AS message FROM conversations""")
def message_texts(spark, d):
    """Texts of chat messages: parts of a payload, its content, or the plain content."""
    c = table(spark, d, "conversations")
    parts = F.to_json(F.struct(F.array(*[F.struct(F.lit(k).alias("type"), t.alias("text")) for k, t in (("text", F.col("role")), ("image", F.lit("no")), ("text", F.col("text")))]).alias("parts")))
    payload = F.when(F.col("turn") % 3 == 0, parts).when(F.col("turn") % 3 == 1, F.to_json(F.struct(F.col("text").alias("content"))))
    return c.select("conv_id", "turn", S.message_text(payload, F.col("role")).alias("message"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, CASE WHEN event_id % 3 = 1 THEN event_id END AS value, CASE WHEN event_id % 3 = 2 THEN 'not json ' || event_id END AS raw FROM events")
def wrapped_json(spark, d):
    """Any text as a JSON object."""
    t = F.when(F.col("event_id") % 3 == 0, F.col("props")).when(F.col("event_id") % 3 == 1, F.col("event_id").cast("string")).otherwise(F.concat(F.lit("not json "), "event_id"))
    o = S.json_object(t)
    return table(spark, d, "events").select("event_id", F.get_json_object(o, "$.k").cast("long").alias("k"), F.get_json_object(o, "$.value").cast("long").alias("value"), F.get_json_object(o, "$.raw").alias("raw"))


@query("SELECT o_orderkey, CAST(o_orderkey % 4 + 2 AS BIGINT) AS row_count, CASE WHEN o_orderkey % 2 = 0 THEN 'csv' ELSE o_orderstatus END AS parser_key FROM orders")
def process_results(spark, d):
    """Row counts and parsers out of stored results."""
    rows = "concat('[', array_join(array_repeat('{}', cast(o_orderkey % 4 as int)), ','), ']')"
    r = f"concat('{{\"records\": {{\"a\": ', {rows}, ', \"b\": [1, 2], \"c\": 5}}, ', if(o_orderkey % 2 = 0, '\"parser_key\": \"csv\"', concat('\"classification\": {{\"selected_parser_key\": \"', o_orderstatus, '\"}}')), '}}')"
    return tables.result_rows(table(spark, d, "orders").select("o_orderkey", F.expr(r).alias("result"))).drop("result")


@query("SELECT o_orderstatus AS parser_key, count(*) AS n FROM orders GROUP BY 1")
def parser_distribution(spark, d):
    return tables.parser_distribution(table(spark, d, "orders").select(F.col("o_orderstatus").alias("parser_key")))


@query("SELECT o_orderstatus AS status, (sum(o_orderkey) // count(*)) // 7 + 1 // 2 AS whole, round(sum(o_totalprice) / count(*), 2) AS price, max((o_orderkey - 50000) / 4.0) AS quarter, min(CASE WHEN o_orderkey >= 50000 THEN (o_orderkey - 50000) // 4 ELSE -((50000 - o_orderkey) // 4) END) AS least FROM orders GROUP BY 1")
def sql_whole_division(spark, d):
    """Divisions of whole numbers drop the fraction, others keep it, as the types of the operands say."""
    table(spark, d, "orders").createOrReplaceTempView("divided_orders")
    text = "SELECT o_orderstatus AS status, sum(o_orderkey) / count(*) / 7 + 1/2 AS whole, round(sum(o_totalprice) / count(*), 2) AS price, max((o_orderkey - 50000) / 4.0) AS quarter, min((o_orderkey - 50000) / 4) AS least FROM divided_orders GROUP BY o_orderstatus"
    return sql.query(spark, text, {"divided_orders"})


@query("WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS s, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE n_chars END AS n FROM documents) SELECT doc_id, row_number() OVER (ORDER BY s NULLS LAST, n DESC NULLS FIRST, doc_id) AS r FROM x ORDER BY s NULLS LAST, n DESC NULLS FIRST, doc_id LIMIT 500")
def sql_null_order(spark, d):
    """Nulls come last in ascending and first in descending order, in windows and at the end (the first 500 rows, a page)."""
    table(spark, d, "documents").selectExpr("doc_id", "if(doc_id % 3 = 0, null, source) as s", "if(doc_id % 5 = 0, null, n_chars) as n").createOrReplaceTempView("ordered_documents")
    return sql.query(spark, "SELECT doc_id, row_number() OVER (ORDER BY s, n DESC, doc_id) AS r FROM ordered_documents ORDER BY s, n DESC, doc_id LIMIT 500", {"ordered_documents"})


@query("SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey, o_totalprice AS price FROM orders WHERE o_orderkey > 10 ORDER BY o_custkey, o_orderstatus, o_orderdate DESC, o_orderkey")
def sql_distinct_on(spark, d):
    """The latest order of each customer and status."""
    table(spark, d, "orders").createOrReplaceTempView("latest_orders")
    return sql.query(spark, "SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey, o_totalprice AS price FROM latest_orders WHERE o_orderkey > 10 ORDER BY o_custkey, o_orderstatus, o_orderdate DESC, o_orderkey", {"latest_orders"})


@query("SELECT event_id FROM events WHERE contains(lower(props), '\"k\": 7') OR contains(lower(event_type), '\"k\": 7')")
def indexed_search(spark, d):
    """The rows of filter_search, found by a trigram bitmap for each block of rows."""
    path = f"{shared_dir(spark)}/tracemill/{uuid.uuid4().hex}"
    search_index.write(_events(spark, d), path, "event_id", 2000)
    return search_index.search(spark, path, '\\"K\\": 7').select("event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'last' WHEN o_orderkey % 5 = 0 THEN 'first' ELSE o_orderpriority END AS priority, CASE WHEN o_orderkey % 5 = 0 THEN 5.5 ELSE o_totalprice END AS price FROM orders WHERE o_orderkey % 11 <> 0")
def changed_rows(spark, d):
    """Thousands of changes to a stored table in one write: the last one of a row and column decides, deleted rows go."""
    c = Catalog(spark, "changed_orders")
    name = f"orders_{uuid.uuid4().hex[:8]}"
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))
    c.create(name, o)
    k, ids = F.col("o_orderkey"), c.table(name)
    change = lambda of, seq, values, deleted=False: ids.where(k % of == 0).select("id", F.lit(seq).cast("long").alias("seq"), F.lit(deleted).alias("deleted"), F.create_map(*map(F.lit, values)).cast("map<string,string>").alias("values"))
    changes = change(7, 2, ["priority", "last"]).unionByName(change(5, 1, ["priority", "first", "price", "5.5"])).unionByName(change(11, 3, ["price", "0"], True))
    c.change(name, changes)
    out = written(c.table(name).drop("id"))
    c.drop(name)
    return out


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 40)")
def unlinked_orders(spark, d):
    """Orders that no large line item links to: orphans that there are."""
    links = table(spark, d, "lineitem").where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.orphans(table(spark, d, "orders"), links, "o_orderkey").select("o_orderkey")
