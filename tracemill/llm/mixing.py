"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected target / source size times. In an order
stratified by size these expectations are summed, one random offset is added,
and a document is emitted once for each integer boundary its own share crosses.
The order's prefix sums are taken in two steps: over (size class, hash) strata,
whose number is bounded, and within a stratum; so no task holds a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, stash

#: Sources in order of their name weigh these, repeating.
WEIGHTS = (1, 2, 3)
#: A source's target is at most so many times its size.
MOST = 3


def _sized(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with the private columns __size, __sc (class of sizes), __hb, __order and __tie (hashes of id and text), __source.

    __source is never null (= before a name, ~ for none, the last), so that a
    join and a window on the strata need one exchange, not two.
    """
    size = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.withColumn("__size", size).withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~")))
    sc = F.expr("case when __size < 8 then __size else 8 * (length(bin(__size)) - 3) + shiftright(__size, cast(length(bin(__size)) - 4 as int)) - 8 end")
    key = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    return d.withColumn("__sc", sc.cast("long")).withColumn("__order", key).withColumn("__hb", F.substring(key, 1, 2)).withColumn("__tie", F.xxhash64(text))


def targets(strata: DataFrame) -> DataFrame:
    """One row for each source: s, source_size, target, rate, shift.

    Targets share the total by weight, none above MOST times its source; what a
    capped source leaves is shared by the others. In order of cap / weight the
    capped sources come first, so one pass over prefix sums finds the level.
    """
    s = strata.groupBy("__source").agg(F.sum("held").alias("source_size"))
    rank = F.row_number().over(Window.orderBy("__source"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((rank - 1) % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("w", weight.cast("long")).withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("w"))
    every = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("ratio", "__source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("level", (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double") / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))))
    s = s.withColumn("lam", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("ratio", "level"))).over(every)["level"])
    s = s.withColumn("target", F.least(F.col("cap").cast("double"), F.col("lam") * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = F.conv(F.substring(F.md5(F.concat(F.lit("offset:"), F.when(F.col("__source") == "~", "\x01").otherwise(F.substring("__source", 2, 2**31 - 1)))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return s.select("__source", "source_size", "target", rate.alias("rate"), shift.alias("shift"))


def _drawn(d: DataFrame) -> DataFrame:
    """Rows of _sized() with __source_size, __target and __copies."""
    keys = ["__source", "__sc", "__hb"]
    strata = stash(d.select("__size", *keys).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("__size").alias("held")), "mix-strata")
    earlier = Window.partitionBy("__source").orderBy("__sc", "__hb").rowsBetween(Window.unboundedPreceding, -1)
    first = strata.withColumn("first", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    t = targets(strata)
    first = first.join(t, first["__source"] == t["__source"]).select(first["__source"].alias("__s"), first["__sc"].alias("__c"), first["__hb"].alias("__h"), F.col("first").alias("__first"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("rate").alias("__rate"), F.col("shift").alias("__shift"))
    d = d.join(first, (d["__source"] == first["__s"]) & (d["__sc"] == first["__c"]) & (d["__hb"] == first["__h"])).drop("__s", "__c", "__h")
    within = Window.partitionBy(*keys).orderBy("__order", "__size", "__tie")
    d = d.withColumn("__at", F.col("__first") + F.row_number().over(within))
    crossed = lambda at: F.floor(F.col("__rate") * at + F.col("__shift"))
    return d.withColumn("__copies", (crossed(F.col("__at")) - crossed(F.col("__at") - 1)).cast("long")).drop("__first", "__rate", "__shift", "__at")


def mix(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, size (words), source_size, target of its source, taken (copies times size).

    A null text has size 0, a null source is a source of its own (the last),
    and rows that repeat each other are documents of their own. Where all texts
    are empty, targets are 0 and nothing is taken.
    """
    d = _drawn(_sized(columns_of(docs, doc_id="long", text="string", source="string")))
    return d.select("doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__copies") * F.col("__size")).alias("taken"))


def emit(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, each as often as the mix takes it."""
    # a row travels packed, so that no column of docs meets one of ours
    packed = docs.select(*[F.col(c).cast(kind).alias(c) for c, kind in (("doc_id", "long"), ("text", "string"), ("source", "string"))], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    d = _sized(packed).drop("doc_id", "text", "source")
    return _drawn(d).where("__copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))).select("row.*")


#: The rows of mix() for DuckDB.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, text, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
c AS (
  SELECT *, CASE WHEN size < 8 THEN size ELSE 8 * (length(bin(size)) - 3) + (size >> (length(bin(size)) - 4)) - 8 END AS sc FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM c GROUP BY source),
r AS (SELECT *, 3 * source_size AS cap, CAST(3 * source_size AS DOUBLE) / w AS ratio FROM s),
l AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS DOUBLE) AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, least(CAST(cap AS DOUBLE), w * (SELECT level FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1)) AS target,
    CAST(CAST('0x' || substr(md5('offset:' || coalesce(source, chr(1))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS shift FROM l),
o AS (
  SELECT c.*, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY c.source ORDER BY sc, ord, size, text) AS nth
  FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST((floor(rate * nth + shift) - floor(rate * (nth - 1) + shift)) AS BIGINT) * size AS taken FROM o
"""
