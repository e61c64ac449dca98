"""How the sources of a language differ in their words: exact divergences, with texts of terms joined late.

Counting moves fixed-width rows only: a term is its 64-bit digest. Each task
tells the texts of its terms once, in rows that the counting does not read. For
the digests that are kept, the least and the greatest text of each are compared;
where they differ, several terms share the digest, and those alone are counted
again by their texts (a split digest goes on as the terms' own keys). Texts come
back only for what is reported: the terms at the head of a ranking.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, only_marked, raw_texts, stash

LEAST_DOCS, TOP = 10, 10
#: A task sums its counts when it holds so many, and hands them on when so many are left; it remembers the digests of so many terms.
MERGE, HELD, KNOWN = 1_000_000, 2_000_000, 400_000
#: Rows in a batch.
BATCH = 200_000
SCALE = 1_000_000_000
#: A ranking is first cut in so many parts, so that no task holds all terms of a source.
PARTS = 32

# Bytes of a term are ASCII letters and all beyond ASCII; others part terms.
_BYTES = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))

_COUNTED = "lang string, source string, digest long, n long, docs long, term string"
_BY_TEXT = "lang string, source string, term string, digest long, n long, docs long"


def _digest(term: bytes, bits: int) -> int:
    return (xxhash.xxh64_intdigest(term, 12) >> 64 - bits) - (1 << 63)


class _Held:
    """Counts of digests by (lang, source), summed from time to time."""

    def __init__(self):
        self.groups: dict[tuple[str, str], list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        self.size = self.summed = 0

    def add(self, group: tuple[str, str], digests: np.ndarray, n: np.ndarray) -> None:
        self.groups.setdefault(group, []).append((digests, n, np.ones(len(n), np.int64)))
        self.size += len(n)

    def sum(self) -> None:
        for group, parts in self.groups.items():
            if len(parts) > 1:
                digests, n, docs = (np.concatenate(x) for x in zip(*parts))
                own, at = np.unique(digests, return_inverse=True)
                # sums of whole numbers, exact below 2**53
                self.groups[group] = [(own, *(np.bincount(at, x).astype(np.int64) for x in (n, docs)))]
        self.size = self.summed = sum(len(parts[0][0]) for parts in self.groups.values())

    def taken(self) -> Iterator[pa.RecordBatch]:
        self.sum()
        for (lang, source), [columns] in self.groups.items():
            for k in range(0, len(columns[0]), BATCH):
                part = [pa.array(x[k : k + BATCH]) for x in columns]
                size = len(part[0])
                yield pa.RecordBatch.from_arrays([*[pa.repeat(pa.scalar(x), size) for x in (lang, source)], *part, pa.nulls(size, pa.string())], [c.split(" ")[0] for c in _COUNTED.split(", ")])
        self.groups, self.size, self.summed = {}, 0, 0


def _counted(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Counts (term null), and the text of each digest (lang null) when a task meets it first."""
    known: dict[bytes, int] = {}
    held = _Held()
    for batch in batches:
        told: list[bytes] = []
        for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw_texts(batch.column("text"))):
            terms = Counter(raw.translate(_BYTES).split())
            if terms:
                for t in set(terms).difference(known):
                    known[t] = _digest(t, bits)
                    told.append(t)
                held.add((lang, source), np.fromiter(map(known.__getitem__, terms), np.int64, len(terms)), np.fromiter(terms.values(), np.int64, len(terms)))
                if held.size - held.summed > MERGE:
                    held.sum()
                    if held.size > HELD:
                        yield from held.taken()
        if told:
            none = [pa.nulls(len(told), k) for k in (pa.string(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none[:2], pa.array(list(map(known.__getitem__, told)), pa.int64()), *none[2:], pa.array(told, pa.binary()).cast(pa.string())], [c.split(" ")[0] for c in _COUNTED.split(", ")])
        if len(known) > KNOWN:
            known.clear()
    yield from held.taken()


def _by_text(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """A row for each term of each document, for the few digests that several terms share."""
    for batch in batches:
        rows = [(lang, source, t, n) for lang, source, raw in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw_texts(batch.column("text"))) for t, n in Counter(raw.translate(_BYTES).split()).items()]
        for k in range(0, len(rows), BATCH):
            lang, source, term, n = zip(*rows[k : k + BATCH])
            columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array([_digest(t, bits) for t in term], pa.int64()), pa.array(n, pa.int64()), pa.array(np.ones(len(n), np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _BY_TEXT.split(", ")])


def _share(n: Column, total: Column, terms: Column) -> Column:
    """The smoothed share in billionths, plus one; decimals, so that no count overflows."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", wide(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * terms)).cast("long") + 1


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _by_term(docs: DataFrame, counted: DataFrame, least_docs: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(lang, source, key, n) of kept terms, and (lang, key, term): the texts of keys that stand for a part of a shared digest.

    key is the digest; of a shared digest, a hash of digest and text.
    """
    counts = stash(counted.where("lang is not null").groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    kept = stash(counts.groupBy("lang", "digest").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest"), "divergence-kept")
    # a digest kept in no language can hide no kept term; of the others, least and greatest text
    asked = _texts(counted, kept)
    shared = asked.groupBy("digest").agg(F.min("term").alias("a"), F.max("term").alias("b")).where("a != b").select("digest")
    shared = stash(shared, "divergence-shared")
    whole = counts.join(kept, ["lang", "digest"], "left_semi").select("lang", "source", F.col("digest").alias("key"), "n")
    if not shared.limit(1).count():
        return whole, whole.select("lang", "key", F.lit(None).cast("string").alias("term")).limit(0)
    again = docs.mapInArrow(lambda batches: _by_text(batches, bits), _BY_TEXT).join(shared, "digest", "left_semi")
    again = stash(again.groupBy("lang", "source", "digest", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-split")
    own = again.groupBy("lang", "digest", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", "digest", "term")
    split = stash(again.join(own, ["lang", "digest", "term"], "left_semi").select("lang", "source", F.xxhash64("digest", "term").alias("key"), "term", "n"), "divergence-parts")
    rows = whole.join(shared.withColumnRenamed("digest", "key"), "key", "left_anti").select("lang", "source", "key", "n").unionByName(split.drop("term"))
    return rows, split.select("lang", "key", "term").distinct()


def _texts(counted: DataFrame, digests: DataFrame) -> DataFrame:
    """(digest, term) as the tasks told them, of some digests."""
    return only_marked(counted.where("term is not null").select("digest", "term"), digests, "digest").join(digests.select("digest").distinct(), "digest", "left_semi")


def divergences(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, digest_bits: int = 64) -> DataFrame:
    """lang, source, part, item, value, rank: what sets each source of a language apart.

    A term is a run of ASCII letters (A-Z as a-z) and characters beyond ASCII. A
    language keeps those in at least least_docs of its documents. Part pair: for
    each other source of the language, the summed distance over all kept terms,
    zero counts included. Part term: the terms that the source uses more than its
    language, the first top of them. Ranks are by value, then by the item's UTF-8.
    Null text, lang and source are read as empty; a repeated row counts each time;
    sources without terms have pairs; an empty table has no rows. Texts are read
    whole, and other columns are left behind. All arithmetic is exact.

    A language's sources are compared by the terms that two of them have; what
    one of both lacks is summed from the other's counts of counts.
    """
    d = columns_of(docs, lang="string", source="string", text="string").na.fill("")
    counted = stash(d.mapInArrow(lambda batches: _counted(batches, digest_bits), _COUNTED), "divergence-counted")
    rows, texts = _by_term(d, counted, least_docs, digest_bits)
    rows = stash(rows, "divergence-terms")
    groups = d.select("lang", "source").distinct()
    kept = stash(rows.groupBy("lang", "key").agg(F.sum("n").alias("all_n")), "divergence-langs")
    langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all_n").alias("all_total"))
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("own"))
    sizes = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "own", "terms", "all_total"])
    sizes = stash(sizes.withColumn("p0", F.when(F.col("terms") > 0, _share(F.lit(0), F.col("total"), F.col("terms"))).otherwise(0)), "divergence-sizes")
    shares = rows.join(sizes, ["lang", "source"]).withColumn("p", _share(F.col("n"), F.col("total"), F.col("terms")))
    shares = stash(shares.select("lang", "source", "key", "n", "p", "p0", "all_total", "terms"), "divergence-shares")
    result = _pairs(shares, sizes).unionByName(_terms(shares, kept, texts, counted, top))
    return result.select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def _pairs(shares: DataFrame, sizes: DataFrame) -> DataFrame:
    """Sources are paired, never documents; a term meets at most the pairs that are reported."""
    a, b = (shares.select("lang", "key", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "p", "p0")]) for s in "ab")
    met = a.join(b, ["lang", "key"]).where("source_a < source_b")
    more = _distance(F.col("p_a"), F.col("p_b")) - _distance(F.col("p_a"), F.col("p0_b")) - _distance(F.col("p0_a"), F.col("p_b")) + _distance(F.col("p0_a"), F.col("p0_b"))
    both = met.groupBy("lang", "source_a", "source_b").agg(F.sum(more).alias("more"))
    # of each ordered pair, what the first one's terms are from the second one's zero
    levels = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("k")).withColumnRenamed("source", "source_a")
    other = sizes.select("lang", F.col("source").alias("source_b"), F.col("p0").alias("p0_b"))
    alone = levels.join(other, "lang").where("source_a != source_b").groupBy("lang", "source_a", "source_b").agg(F.sum(F.col("k") * _distance(F.col("p"), F.col("p0_b"))).alias("alone"))
    x, y = (sizes.select("lang", F.col("source").alias(f"source_{s}"), F.col("own").alias(f"own_{s}"), F.col("p0").alias(f"p0_{s}"), F.col("terms").alias(f"terms_{s}")) for s in "ab")
    pairs = x.join(y, "lang").where("source_a < source_b")
    turned = alone.select("lang", F.col("source_a").alias("source_b"), F.col("source_b").alias("source_a"), F.col("alone").alias("turned"))
    on = ["lang", "source_a", "source_b"]
    pairs = pairs.join(both, on, "left").join(alone, on, "left").join(turned, on, "left").na.fill(0, ["more", "alone", "turned"])
    neither = (F.col("terms_a") - F.col("own_a") - F.col("own_b")) * _distance(F.col("p0_a"), F.col("p0_b"))
    value = F.when(F.col("terms_a") > 0, F.col("more") + F.col("alone") + F.col("turned") + neither).otherwise(0)
    pairs = pairs.select("lang", "source_a", "source_b", value.alias("value"))
    ways = pairs.select("lang", F.explode(F.array(*[F.struct(F.col(f"source_{s}").alias("source"), F.col(f"source_{t}").alias("item"), "value") for s, t in ("ab", "ba")])).alias("x"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return ways.select("lang", "x.*").select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))


def _terms(shares: DataFrame, kept: DataFrame, texts: DataFrame, counted: DataFrame, top: int) -> DataFrame:
    q = _share(F.col("all_n"), F.col("all_total"), F.col("terms"))
    more = shares.join(kept, ["lang", "key"]).withColumn("q", q).where("p > q")
    valued = more.select("lang", "source", "key", _distance(F.col("p"), F.col("q")).alias("value"))
    # texts decide between equal values only, so all that equal the last one wait for theirs
    first = valued.withColumn("r", F.rank().over(Window.partitionBy("lang", "source", F.pmod("key", F.lit(PARTS))).orderBy(F.desc("value")))).where(F.col("r") <= top)
    head = first.withColumn("r", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value")))).where(F.col("r") <= top).drop("r")
    head = stash(head, "divergence-heads")
    split = head.join(texts, ["lang", "key"]).select("lang", "source", "key", "value", F.col("term").alias("item"))
    plain = head.join(texts, ["lang", "key"], "left_anti")
    asked = plain.select(F.col("key").alias("digest")).distinct()
    names = _texts(counted, asked).groupBy(F.col("digest").alias("key")).agg(F.min("term").alias("item"))
    named = plain.join(names, "key").select("lang", "source", "key", "value", "item").unionByName(split)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return named.select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= top)


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
per_doc AS (SELECT id, lang, source, term, count(*) AS n FROM w GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM per_doc GROUP BY lang, term HAVING count(*) >= 10),
groups AS (SELECT DISTINCT lang, source FROM d),
counts AS (SELECT lang, source, term, sum(n) AS n FROM per_doc GROUP BY ALL),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS all_n
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), sized AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)) // (sum(n) OVER s + 2 * count(*) OVER s) AS p,
         1 + (1000000000 * (all_n + 2)) // (sum(all_n) OVER s + 2 * count(*) OVER s) AS q
  FROM dense WINDOW s AS (PARTITION BY lang, source)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM sized a JOIN sized b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), all_pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), own AS (
  SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM sized WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM (SELECT * FROM all_pairs UNION ALL SELECT * FROM own)
)
SELECT lang, source, part, item, value, r::INTEGER AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""
