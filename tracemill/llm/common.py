"""What the operators of this package share: the shared folder, raw text access, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset: in local mode one of our own, on a cluster an error."""
    conf = spark.sparkContext.getConf()
    at = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not at:
        if not (conf.get("spark.master") or "").startswith("local") or (conf.get("spark.master") or "").startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        at = _own_dir.setdefault(app, tempfile.mkdtemp(prefix="tracemill-"))
    return at.rstrip("/")


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts the lineage and outlives executors.

    The table goes when the application ends, or before with drop().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tracemill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def drop(stashed: DataFrame) -> None:
    """Deletes a stash() that nothing will read again."""
    spark = stashed.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stashed.stashed_at)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """For each wanted name one that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Of the bitmap in only_marked() (4 MB).
BITS = 1 << 25


def only_marked(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """df without most of the rows whose value (a bigint) none of keys has, before they move: a bitmap of BITS bits, whatever the size.

    The more of it is set, the fewer it holds back; the join that follows decides.
    """
    slot = F.pmod(column, F.lit(BITS)) + 1
    bitmaps = keys.groupBy(F.bitmap_bucket_number(slot).alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("__bits"))
    d = df.withColumn("__bit", F.bitmap_bit_position(slot)).join(F.broadcast(bitmaps), F.bitmap_bucket_number(slot) == F.col("__bucket"))
    byte = "cast(conv(hex(substring(__bits, cast(__bit div 8 as int) + 1, 1)), 16, 10) as int)"
    return d.where(F.expr(f"shiftright({byte}, cast(__bit % 8 as int)) & 1 = 1")).select(*df.columns)


def columns_of(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns, cast; extra columns are left behind."""
    return df.select(*[df[c].cast(kind).alias(c) for c, kind in kinds.items()])


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most n rows, those whose keys hash lowest; the same on every run.

    A cut that the row count gives is applied where the rows are read, so that
    little more than n of them ever move.
    """
    total = df.count()
    place = F.pmod(F.xxhash64(*keys), F.lit(1 << 30))
    if total > 2 * n:
        df = df.where(place < int((1.2 * n + 200) / total * (1 << 30)) + 1)
    return df.orderBy(place, *keys).limit(n)


def raw_texts(column: pa.Array) -> Iterator[bytes | None]:
    """The UTF-8 bytes of each text, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return iter(column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist())


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """(u, v) links between bigints -> (node, root): the smallest node of each component of linked nodes.

    Alternates large-star and small-star steps; each round is one written
    table, and a hot node is only ever met in joins that Spark can split.
    """
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = stash(now, tag)
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # every node also keeps its own link to the minimum it has seen
        large = large.unionByName(least.where("u != m").select("u", F.col("m").alias("v"))).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stash(small.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u != v").distinct(), tag)
        drop(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return int(row[0]), row[1]
