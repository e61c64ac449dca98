"""What runs teach, kept across runs: a stream of outcomes into keyed state that expires, and a table bounded by rank.

A run drops its outcomes into a folder (engine.learn). The stream sums them for
each schema; a schema without a new outcome for TTL_DAYS of event time is told as
expired, by a timer. Each batch makes a new version of the store from the last
one, so that a batch that is run again makes the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import cache

OUTCOMES = "schema_key string, fingerprint string, domain string, profile string, detected_format string, format_confidence double, structural_class string, ok boolean, at timestamp"
_ENTRY = ("fingerprint", "domain", "profile", "detected_format", "format_confidence", "structural_class")
_KEPT = "fingerprint string, domain string, profile string, detected_format string, format_confidence double, structural_class string, successes long, failures long, access_count long, updated_at timestamp"
STORE = f"schema_key string, {_KEPT}"
_CHANGE = f"{STORE}, expired boolean"
LIMIT = 1000


def outcome_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """New outcome files below path."""
    return spark.readStream.schema(OUTCOMES).option("maxFilesPerTrigger", max_files).parquet(path)


def _summed(key: tuple[str], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One key's counts; the entry is that of its latest outcome. A timer tells it as expired."""
    names = [c.split(" ")[0] for c in _KEPT.split(", ")]
    if state.hasTimedOut:
        last = state.get
        state.remove()
        yield pd.DataFrame([(key[0], *last, True)], columns=["schema_key", *names, "expired"])
        return
    last = list(state.get) if state.exists else [None] * 6 + [0, 0, 0, None]
    for frame in frames:
        frame = frame.sort_values(["at", *_ENTRY], kind="stable", na_position="first")
        won = int(frame["ok"].fillna(False).sum())
        newest = frame.iloc[-1]
        if last[9] is None or newest["at"] >= last[9]:
            last[:6], last[9] = [None if pd.isna(newest[c]) else newest[c] for c in _ENTRY], newest["at"].to_pydatetime()
        last[6], last[7], last[8] = last[6] + won, last[7] + len(frame) - won, last[8] + len(frame)
    state.update(tuple(last))
    due = int(pd.Timestamp(last[9]).timestamp() * 1000) + cache.TTL_DAYS * 86_400_000
    state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame([(key[0], *last, False)], columns=["schema_key", *names, "expired"])


def changes(outcomes: DataFrame, late: str = "1 day") -> DataFrame:
    """The stream of changes to the store: the new sums of each schema that had outcomes, and those that expired."""
    events = outcomes.where("schema_key is not null and at is not null").withWatermark("at", late)
    return events.groupBy("schema_key").applyInPandasWithState(_summed, _CHANGE, _KEPT, "update", GroupStateTimeout.EventTimeTimeout)


def _versions(spark: SparkSession, path: str) -> list[int]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The store's last version (before a batch), empty if there is none."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.schema(STORE).parquet(f"{path}/version={found[-1]}") if found else spark.createDataFrame([], STORE)


def keeper(path: str, limit: int = LIMIT) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: the last version with a batch's changes, without what expired, the limit that were used last."""

    def keep(batch: DataFrame, number: int) -> None:
        store = current(batch.sparkSession, path, number)
        rest = store.join(batch.select("schema_key"), "schema_key", "left_anti")
        both = cache.put(rest, batch.where("not expired").drop("expired"))
        now = F.lit(both.agg(F.max("updated_at")).first()[0]).cast("timestamp")  # event time: the latest outcome
        cache.evict(both, now, limit).select(*[c.split(" ")[0] for c in STORE.split(", ")]).write.mode("overwrite").parquet(f"{path}/version={number}")

    return keep


def keep_available(outcomes: DataFrame, path: str, checkpoint: str, limit: int = LIMIT):
    """Takes in what has arrived and stops; a rerun goes on where this ended."""
    return changes(outcomes).writeStream.outputMode("update").foreachBatch(keeper(path, limit)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
