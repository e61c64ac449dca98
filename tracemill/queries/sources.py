"""Files that Spark derives from the tables, written once and read back from splits."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import records
from ..sources.shared import shared_dir
from .base import registry, table

QUERIES, query = registry()

N_FILES = 4


def _as_files(rows: DataFrame, key: str, head: str, line: Column, tail: str) -> str:
    """A folder with a file for each remainder of key: head, a line for each row by key, tail."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/tracemill/{uuid.uuid4().hex}"
    body = rows.select((F.col(key) % N_FILES).alias("part"), F.lit(1).alias("nth"), F.col(key).alias("key"), line.alias("line"))
    ends = body.select("part").distinct().select("part", F.explode(F.array(F.struct(F.lit(0).alias("nth"), F.lit(head).alias("line")), F.struct(F.lit(2).alias("nth"), F.lit(tail).alias("line")))).alias("x"))
    both = body.unionByName(ends.select("part", "x.nth", F.lit(0).alias("key"), "x.line"))
    both.repartition(N_FILES, "part").sortWithinPartitions("part", "nth", "key").select("part", "line").write.partitionBy("part").text(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@query("""SELECT o_orderkey AS "key", o_orderstatus AS status, '}{"[' || o_orderpriority || chr(92) || '"' AS note, o_custkey AS cust, row_number() OVER (PARTITION BY o_orderkey % 4 ORDER BY o_orderkey) AS row_no FROM orders""")
def json_list_records(spark, d):
    """Huge JSON lists read from splits: brackets, quotes and escapes in strings, nested objects, and a scalar ahead of the objects."""
    o = table(spark, d, "orders")
    note = F.concat(F.lit('}{"['), "o_orderpriority", F.lit('\\"'))
    item = F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), note.alias("note"), F.struct(F.col("o_custkey").alias("cust")).alias("by")))
    path = _as_files(o, "o_orderkey", '["{", {"not": "an order"}', F.concat(F.lit(", "), item), "]")
    f = F.col("fields")
    read = records.json_records(spark, path).where(~F.map_contains_key("fields", F.lit("not")))
    return read.select(f["key"].cast("long").alias("key"), f["status"].alias("status"), f["note"].alias("note"), f["by_cust"].cast("long").alias("cust"), (F.col("row_no") - 1).alias("row_no"))


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, c_nationkey AS nation, row_number() OVER (PARTITION BY c_custkey % 4 ORDER BY c_custkey) AS row_no FROM customer""")
def xml_split_records(spark, d):
    """Huge XML files read from splits by their repeated element: attributes, leaves, nested elements."""
    c = table(spark, d, "customer")
    line = F.concat(F.lit('<Customer id="'), "c_custkey", F.lit('"><name>'), "c_name", F.lit("</name><in><segment>"), "c_mktsegment", F.lit("</segment><nation>"), "c_nationkey", F.lit("</nation></in></Customer>"))
    path = _as_files(c, "c_custkey", '<?xml version="1.0"?><all made="here">', line, "</all>")
    f = F.col("fields")
    inner = F.from_json(f["in"], "segment string, nation string")
    read = records.xml_records(spark, path).withColumn("inner", inner)
    return read.select(f["id"].cast("long").alias("id"), f["name"].alias("name"), F.col("inner.segment").alias("segment"), F.col("inner.nation").cast("long").alias("nation"), "row_no")
