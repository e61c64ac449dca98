"""Stores of what earlier runs learned: schemas by fingerprint, examples by signature.

A store is a table that only grows; lookups take the latest row of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_DAYS, MIN_CONFIDENCE, HEALTHY = 30, 0.85, 0.7
PER_KEY = 10


def schema_key(fmt: Column, domain: Column, profile: Column, sample: Column) -> Column:
    return F.concat_ws(":", fmt, domain, profile, F.substring(F.md5(sample), 1, 16))


def latest(store: DataFrame, key: str = "schema_key", order: str = "updated_at") -> DataFrame:
    """One row for each key, the one that was written last."""
    rest = [c for c in store.columns if c != key]
    return store.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order, *[F.col(c).cast("string") for c in rest])).alias("r")).select(key, "r.*")


def put(store: DataFrame, entries: DataFrame) -> DataFrame:
    """The store with entries; an equal key is replaced."""
    return latest(store.unionByName(entries, allowMissingColumns=True))


def get(store: DataFrame, keys: DataFrame, now: Column) -> DataFrame:
    """Entries of the asked keys (schema_key) that haven't expired."""
    return latest(store).join(keys, "schema_key", "left_semi").where(F.col("updated_at") >= now - F.expr(f"interval {TTL_DAYS} days"))


def health(successes: Column, failures: Column) -> Column:
    """Share of uses that went well; a half where there was none."""
    return F.coalesce(F.try_divide(successes, successes + failures), F.lit(0.5))


def by_fingerprint(store: DataFrame, wanted: DataFrame, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The best entry for each wanted (fingerprint, domain[, profile]): by confidence, then health, then use."""
    keys = [c for c in ("fingerprint", "domain", "profile") if c in wanted.columns]
    d = store.where(F.col("format_confidence") >= min_confidence).join(wanted.select(*keys).distinct(), keys, "left_semi")
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("format_confidence"), F.desc(health(F.col("successes"), F.col("failures"))), F.desc("access_count"), "schema_key"))
    return d.withColumn("nth", best).where("nth = 1").drop("nth")


def by_format(store: DataFrame, fmt: str, k: int = 5) -> DataFrame:
    return store.where(F.col("detected_format") == fmt).orderBy(F.desc(health(F.col("successes"), F.col("failures"))), F.desc("access_count"), "schema_key").limit(k)


def record(store: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The store with the counts of outcomes (schema_key, ok) added."""
    g = outcomes.groupBy("schema_key").agg(F.count_if("ok").alias("won"), F.count_if(~F.col("ok")).alias("lost"))
    d = store.join(g, "schema_key", "left")
    return d.withColumn("successes", F.col("successes") + F.coalesce("won", F.lit(0))).withColumn("failures", F.col("failures") + F.coalesce("lost", F.lit(0))).drop("won", "lost")


def stats(store: DataFrame, now: Column) -> DataFrame:
    h = health(F.col("successes"), F.col("failures"))
    return store.agg(F.count("*").alias("n_entries"), F.count_if(F.col("updated_at") < now - F.expr(f"interval {TTL_DAYS} days")).alias("n_expired"), F.count_if(h > HEALTHY).alias("n_healthy"), F.sum("access_count").alias("n_accesses"))


def evict(store: DataFrame, now: Column, limit: int = 1000) -> DataFrame:
    """Without expired entries, and of the rest the limit that were used last."""
    return store.where(F.col("updated_at") >= now - F.expr(f"interval {TTL_DAYS} days")).orderBy(F.desc("updated_at"), "schema_key").limit(limit)


def few_shot_signature(fmt: Column, domain: Column, profile: Column, fingerprint: Column, fields: Column) -> Column:
    return F.md5(F.concat_ws(":", fmt, domain, profile, fingerprint, F.array_join(F.array_sort(fields), ",")))


def add_few_shots(store: DataFrame, examples: DataFrame) -> DataFrame:
    """Examples of equal signature count as uses of one; the PER_KEY most used of a (format, domain) stay."""
    both = store.unionByName(examples, allowMissingColumns=True)
    g = both.groupBy("signature").agg(F.first("format").alias("format"), F.first("domain").alias("domain"), F.max("confidence").alias("confidence"), F.sum("usage").alias("usage"))
    nth = F.row_number().over(Window.partitionBy("format", "domain").orderBy(F.desc("usage"), F.desc("confidence"), "signature"))
    return g.withColumn("nth", nth).where(F.col("nth") <= PER_KEY).drop("nth")


def few_shots(store: DataFrame, domain: str, k: int = 3) -> DataFrame:
    """The k most used examples of a domain or of unknown domain, then by confidence."""
    return store.where(F.col("domain").isin(domain, "unknown")).dropDuplicates(["signature"]).orderBy(F.desc("usage"), F.desc("confidence"), "signature").limit(k)
