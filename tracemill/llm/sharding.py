"""Sharding by sampled splitters, in DataFrame operations only. The law is bytes: sizes near equal.

Records are ordered by (hash of the text, hash of the id). Keys are drawn with
a chance in proportion to size, their quantiles become splitters, and records
are range-partitioned by them; a range that came out overfull is cut again by
key. Exact sums of these ranges then put every record at its place in the
global order of bytes, and a shard is an equal share of that order. Equal texts
are neighbours in it: a group of them that a boundary would cut goes whole to
the side of its middle, unless it is more than WHOLE of a shard; a larger one is
cut, so that sizes stay near equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, stash

SHARDS = 24
#: Bytes of text for each range, and the most ranges (a range holds some 40 bytes for each of its documents, no text); keys
#: drawn for each range.
RANGE_BYTES, MOST_RANGES, DRAWS = 16_000_000, 4096, 16
#: The share of a shard up to which a group of equal texts is kept in one.
WHOLE = 1 / 64


def records(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, th, key: what sharding knows of a document; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    rows = columns_of(docs, doc_id="long", text="string").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("th"))
    by_id = F.shiftrightunsigned(F.xxhash64("doc_id", "th"), 33)
    return rows.withColumn("key", F.shiftleft("text_crc32", 31).bitwiseOR(by_id))


def splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantiles of at most about DRAWS keys a range, drawn in proportion to size."""
    chance = F.col("size") * (DRAWS * ranges) / F.lit(max(total, 1))
    draw = F.pmod(F.xxhash64("key", F.lit("draw")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sorted(r.key for r in rows.where(draw < chance).select("key").collect())
    return sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)}) if drawn else []


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row for each document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law).

    A null text counts as empty. Rows that repeat each other get slots of their
    own. An empty table gives no row.
    """
    rows = stash(records(docs), "shard-records")
    total = rows.agg(F.sum("size")).first()[0] or 0
    ranges = max(2 * shards, min(MOST_RANGES, total // RANGE_BYTES))
    cuts = splitters(rows, total, ranges)
    if cuts:
        array = f"cast(split('{','.join(map(str, cuts))}', ',') as array<bigint>)"
        # binary search: how many splitters are at or below the key
        top = max(len(cuts).bit_length() - 1, 0)
        step = "shiftleft(1, b)"
        found = F.expr(f"aggregate(sequence({top}, 0), 0, (low, b) -> if(low + {step} <= {len(cuts)} and {array}[low + {step} - 1] <= key, low + {step}, low))") if top else F.expr(f"if({array}[0] <= key, 1, 0)")
    else:
        found = F.lit(0)
    rows = rows.withColumn("rng", found)
    # an overfull range is cut into equal intervals of its keys
    full = rows.groupBy("rng").agg(F.sum("size").alias("held"), F.min("key").alias("low"), F.max("key").alias("high"))
    full = full.where(F.col("held") > 2 * max(total // ranges, 1)).withColumn("parts", F.ceil(F.col("held") / F.lit(max(total / ranges, 1.0))))
    rows = rows.join(F.broadcast(full), "rng", "left")
    sub = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low") + 1).cast("double") * F.col("parts")), F.col("parts") - 1)
    rows = rows.withColumn("sub", F.coalesce(sub, F.lit(0)).cast("int")).drop("held", "low", "high", "parts")

    # at most MOST_RANGES ranges and as many parts: a table of bounded size
    cells = rows.groupBy("rng", "sub").agg(F.sum("size").alias("held"), F.count("*").alias("n"))
    before = Window.orderBy("rng", "sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("rng", "sub", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("rng", "sub").orderBy("key", "th", "doc_id")
    rows = rows.join(F.broadcast(cells), ["rng", "sub"]).withColumn("upto", F.col("base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("rank", F.col("first") + F.row_number().over(within))
    # the middle of a record decides
    of_middle = lambda twice: F.least(F.floor(twice * shards / F.lit(2.0 * max(total, 1))), F.lit(shards - 1)).cast("int")
    rows = rows.withColumn("shard", of_middle(2 * F.col("upto") - F.col("size")))
    rows = stash(rows.select("doc_id", "size", "text_crc32", "upto", "rank", "shard"), "shard-rows")

    # groups that a boundary cuts, at most one for each: those small enough go by their own middle
    ends = rows.groupBy("shard").agg(F.min(F.struct("rank", "text_crc32")).alias("a"), F.max(F.struct("rank", "text_crc32")).alias("b")).orderBy("shard").collect()
    cut = [x.b.text_crc32 for x, y in zip(ends, ends[1:]) if x.b.text_crc32 == y.a.text_crc32]
    if cut:
        groups = rows.where(F.col("text_crc32").isin(cut)).groupBy("text_crc32").agg(F.sum("size").alias("held"), F.min(F.col("upto") - F.col("size")).alias("low"), F.max("upto").alias("high"))
        groups = groups.where(F.col("held") <= WHOLE * total / shards).select("text_crc32", of_middle(F.col("low") + F.col("high")).alias("to"))
        rows = rows.join(F.broadcast(groups), "text_crc32", "left").withColumn("shard", F.coalesce("to", "shard"))
    first = rows.groupBy("shard").agg(F.min("rank").alias("least"))
    out = rows.join(F.broadcast(first), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("least")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
