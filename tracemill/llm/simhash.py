"""SimHash near-duplicates: fingerprints, pivot distance tables, components.

Distances of each fingerprint to reference fingerprints (pivots) are computed
beforehand, over all bits and over each choice of three of five parts of the
bits. Two fingerprints at most two bits apart leave three parts whole, so over
these their coordinates are the same at every pivot: they meet in that cell of
the table. In a cell, a pair whose coordinates over all bits differ by more than
two at any pivot is discarded by the triangle inequality, and the rest is
verified bit by bit. A hot cell (more than CELL fingerprints) is not paired:
each of its fingerprints lists its 65 centres (itself and each one-bit change),
and two fingerprints are at most two bits apart exactly if they share a centre.
Both ways are exact, and no cell emits all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, components, raw_texts, stash

SEED, SHINGLE, RADIUS = 42, 3, 2
#: Above so many distinct fingerprints a cell of the pivot table is linked by centres instead of pairs.
CELL = 24
N_PIVOTS, PARTS = 16, 5


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


#: Reference fingerprints, the same on every run.
PIVOTS = [_signed(xxhash.xxh64_intdigest(f"pivot {k}", seed=SEED)) for k in range(N_PIVOTS)]
_EDGES = [64 * k // PARTS for k in range(PARTS + 1)]
#: The bits of each choice of all parts but RADIUS.
MASKS = [_signed(sum(((1 << _EDGES[k + 1]) - (1 << _EDGES[k])) for k in kept)) for kept in combinations(range(PARTS), PARTS - RADIUS)]


def _distances(mask: int) -> list[str]:
    """SQL: of fp, the distance to each pivot over the bits of mask."""
    return [f"bit_count((fp ^ {p}L) & {mask}L)" for p in PIVOTS]


def fingerprint(raw: bytes | None) -> int:
    """The unsigned fingerprint of a UTF-8 text; zero without words."""
    words = (raw or b"").lower().split()
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[: n - SHINGLE].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(x) for x in raw_texts(batch.column("text"))], np.uint64).view(np.int64)
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in others], pa.array(found)], [*others, "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed bigint."""
    return columns_of(docs, doc_id="long", text="string").mapInArrow(_fingerprints, "doc_id long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) -> (u, v) links that connect exactly what lies within RADIUS bits."""
    cells = ", ".join(f"named_struct('t', cast({t} as tinyint), 'k', xxhash64({', '.join(_distances(m))}))" for t, m in enumerate(MASKS))
    rows = nodes.select("fp", F.explode(F.expr(f"array({cells})")).alias("x")).select("fp", "x.t", "x.k")
    full = rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    met = stash(rows.join(full, ["t", "k"]), "simhash-cells")

    few = met.where(F.col("n") <= CELL).select("t", "k", "fp", *[F.expr(f"cast({d} as tinyint)").alias(f"d{i}") for i, d in enumerate(_distances(-1))])
    a, b = few.alias("a"), few.alias("b")
    near = reduce(lambda x, y: x & y, [F.abs(F.col(f"a.d{i}") - F.col(f"b.d{i}")) <= RADIUS for i in range(N_PIVOTS)])
    apart = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    pairs = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.k") == F.col("b.k")) & (F.col("a.fp") < F.col("b.fp")) & near).where(F.bit_count(apart) <= RADIUS)
    pairs = pairs.select(F.col("b.fp").alias("u"), F.col("a.fp").alias("v"))

    many = met.where(F.col("n") > CELL).select("fp").distinct()
    centres = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(_signed(1 << k))) for k in range(64)])
    seen = many.select("fp", F.explode(centres).alias("c"))
    least = seen.groupBy("c").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = seen.join(least, "c").where("fp != m").select(F.col("fp").alias("u"), F.col("m").alias("v"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, fingerprint (hex), component_id.

    Null and empty texts have fingerprint zero and link like any other. The
    component_id is the smallest doc_id that is linked directly or through
    others; null ids are passed over (null only where all ids are).
    """
    marks = stash(fingerprints(docs), "simhash-fingerprints")
    return _components(marks).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(nodes: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp, least) with the root of each one's component."""
    roots = stash(components(links(nodes.select("fp")), "simhash-cc"), "simhash-roots")
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def _components(marks: DataFrame) -> DataFrame:
    rooted = _rooted(stash(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return marks.join(rooted.join(named, "root").select("fp", "component_id"), "fp")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names: of each component the document with the smallest id.

    Where several of its texts carry that id, the lowest by hash stays, and of
    rows with the same id and text one. Null ids come last, so a component whose
    ids are all null keeps one row. Components that share an id each keep theirs.
    """
    marks = columns_of(docs, doc_id="long", text="string").withColumn("mark", F.xxhash64("text"))
    marks = stash(marks.mapInArrow(_fingerprints, "doc_id long, mark long, fp long"), "simhash-fingerprints")
    texts = marks.groupBy("fp", "doc_id", "mark").agg(F.count("*").alias("n"))
    least = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "mark", "n")).alias("least")
    first = _rooted(stash(texts.groupBy("fp").agg(least), "simhash-nodes")).groupBy("root").agg(F.min("least").alias("least"))
    first = stash(first.select(F.col("least.doc_id").alias("id"), F.col("least.mark").alias("mark"), (F.col("least.n") > 1).alias("more")), "simhash-kept")
    # a row travels packed, so that no column of docs meets one of ours; the ids grow with the corpus, so they are never broadcast
    rows = docs.select(F.col("doc_id").cast("long").alias("of"), F.xxhash64(F.col("text").cast("string")).alias("own"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(first.hint("merge"), F.col("of").eqNullSafe(F.col("id")) & (F.col("own") == F.col("mark")))
    once = kept.where(~F.col("more")).select("row.*")
    order = F.xxhash64(*[F.col(f"row.`{c}`") for c, kind in docs.dtypes if "map<" not in kind])
    twice = kept.where("more").withColumn("nth", F.row_number().over(Window.partitionBy("id", "mark").orderBy(order)))
    return once.unionByName(twice.where("nth = 1").select("row.*"))
