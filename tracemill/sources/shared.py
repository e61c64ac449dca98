"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: in local mode (tests) a folder of our own, on a cluster an error."""
    conf = spark.sparkContext.getConf()
    at, master = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir"), conf.get("spark.master") or ""
    if not at and (not master.startswith("local") or master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (at or _own.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tracemill-"))).rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: computed once, without lineage, safe from lost executors. It goes when the application ends."""
    path = f"{shared_dir(df.sparkSession)}/tracemill/{uuid.uuid4().hex}"
    df.write.parquet(path)
    context = df.sparkSession.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame) -> DataFrame:
    """df, its columns computed once for each row: Spark moves neither filters nor expressions from above a generator to below it."""
    return df.select(F.explode(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))).alias("r")).select("r.*")
