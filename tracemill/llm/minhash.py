"""MinHash near-duplicates: fast similarity sketches, bands, exact verification in blocks.

A sketch has COORDINATES = BANDS * ROWS coordinates. In round i each shingle is
hashed to one of them and leaves i + a fraction there; the least value stays.
From round COORDINATES on, all shingles go to coordinate i - COORDINATES. Rounds
end when every coordinate is filled, as is certain in the last ones, so sketches
of sets of any size agree in a coordinate with the probability of their Jaccard
similarity, as closely concentrated as those of independent hashes.

1. Documents of equal sets are one node; nodes that agree in all ROWS coordinates
   of a band meet in that band's bucket. At a similarity of 0.8 two nodes meet in
   none of the 40 bands with a chance of 7e-10 (0.5904 ** 40).
2. Star: each node of a bucket is verified against its least one; what is linked
   is one component.
3. Buckets that still hold several components are gone through in blocks: nodes
   are put into blocks of at most BLOCK of like size, and each two blocks that a
   bucket joins are verified together, all nodes of the one against all of the
   other, by counting common shingles with a matrix product. Components that are
   linked already aren't compared again, and no rows of pairs are ever made: a
   block gives the links that join its components.

Every comparison is between full sets of 64-bit shingle hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, components, only_marked, raw_texts, stash

SHINGLE, PERCENT = 2, 80
BANDS, ROWS = 40, 4
COORDINATES = BANDS * ROWS
#: Nodes in a block, and shingles in its sets together (a larger set is a block of its own).
BLOCK, BLOCK_SHINGLES = 128, 1 << 17
#: Columns of the matrix product at a time.
WIDTH = 4096

_MASK32 = np.uint64(0xFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


class Shingles:
    """The set of a text's shingles as sorted 64-bit hashes; hashes of words are kept while there are not too many."""

    def __init__(self, length: int = SHINGLE, most: int = 300_000):
        self.length, self.most, self.known = length, most, {}

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = (raw or b"").lower().split()  # bytes: A-Z alone, ASCII white space
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 13)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.length, len(h))
        if not k:
            return h
        out = h[: len(h) - k + 1] + np.uint64(k)
        for j in range(1, k):
            out = _mix(out) * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
        return np.unique(_mix(out))


def sketch(items: np.ndarray) -> np.ndarray:
    """The coordinates of a set of 64-bit hashes that isn't empty."""
    t, rounds = COORDINATES, np.uint64(32)
    values = np.full(t, ~np.uint64(0))
    for i in range(2 * t):
        h = _mix(items + np.uint64((i + 1) * 0xD1342543DE82EF95 % 2**64))
        v = np.uint64(i) << rounds | h & _MASK32
        if i < t:
            np.minimum.at(values, ((h >> rounds) * np.uint64(t) >> rounds).astype(np.int64), v)
        else:
            values[i - t] = min(values[i - t], v.min())
        if values.max() != ~np.uint64(0):
            break
    return values


def bands(values: np.ndarray) -> np.ndarray:
    """One 64-bit hash for each ROWS coordinates."""
    out = np.zeros(BANDS, np.uint64)
    for column in values.reshape(BANDS, ROWS).T:
        out = _mix(out * np.uint64(31) + column)
    return out


_MARKS = "doc_id long, mark long, n long, h1 long, h2 long, bands array<long>"


def _marked(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(length)
        for batch in batches:
            n, ids, found = [], [], []
            for raw in raw_texts(batch.column("text")):
                s = shingles(raw)
                n.append(len(s))
                own = s.tobytes()
                ids.append((xxhash.xxh64_intdigest(own, 1), xxhash.xxh64_intdigest(own, 2)))
                found.append(bands(sketch(s)).view(np.int64) if len(s) else None)
            h = np.array(ids, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "mark", "n", "h1", "h2", "bands"])

    return run


def _sets(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(length)
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                part = batch.slice(a, 500)
                items = [shingles(raw).tobytes() for raw in raw_texts(part.column("text"))]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(items, pa.binary())], ["node", "items"])

    return run


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many items each set of a and each of b have in common."""
    out = np.zeros((len(a), len(b)), np.int64)
    if not a or not b:
        return out
    x, y = np.concatenate(a), np.concatenate(b)
    vocabulary = np.intersect1d(x, y)
    for lo in range(0, len(vocabulary), WIDTH):
        v = vocabulary[lo : lo + WIDTH]
        dense = []
        for flat, sets in ((x, a), (y, b)):
            at = np.searchsorted(v, flat)
            own = v[np.minimum(at, len(v) - 1)] == flat
            m = np.zeros((len(sets), len(v)), np.float32)
            m[np.repeat(np.arange(len(sets)), [len(s) for s in sets])[own], at[own]] = 1
            dense.append(m)
        out += (dense[0] @ dense[1].T).astype(np.int64)
    return out


def block_links(nodes: list[int], roots: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components of a block (side 0) and another (side 1; none: the block itself)."""
    left = [k for k, s in enumerate(sides) if s == 0]
    right = [k for k, s in enumerate(sides) if s == 1] or left
    sizes = np.array([len(s) for s in sets])
    common = common_counts([sets[k] for k in left], [sets[k] for k in right])
    near = 100 * common >= percent * (sizes[left][:, None] + sizes[right][None, :] - common)
    above = {r: r for r in roots}

    def top(r: int) -> int:
        while above[r] != r:
            above[r] = r = above[above[r]]
        return r

    out = []
    for i, j in zip(*np.nonzero(near)):
        p, q = left[i], right[j]
        r, s = top(roots[p]), top(roots[q])
        if r != s:
            above[max(r, s)] = min(r, s)
            out.append((max(nodes[p], nodes[q]), min(nodes[p], nodes[q])))
    return out


def _verified(percent: int):
    def run(table: pa.Table) -> pa.Table:
        rows = {(s, n): (r, items) for s, n, r, items in zip(*(table.column(c).to_pylist() for c in ("side", "node", "root", "items")))}
        keys = list(rows)
        found = block_links([n for _, n in keys], [rows[k][0] for k in keys], [s for s, _ in keys], [np.frombuffer(rows[k][1], np.uint64) for k in keys], percent)
        return pa.table({c: pa.array([x[i] for x in found], pa.int64()) for i, c in enumerate(("u", "v"))})

    return run


def _links(blocks: DataFrame, nodes: DataFrame, docs: DataFrame, length: int, percent: int) -> DataFrame:
    """blocks (block, side, node, root) -> (u, v): verified links that connect what is near across the sides of a block."""
    wanted = stash(nodes.join(blocks.select("node").distinct(), "node", "left_semi").select("node", "least", "mark"), "minhash-wanted")
    a, b = only_marked(docs, wanted, "mark").alias("a"), wanted.alias("b")
    texts = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.least")) & (F.col("a.mark") == F.col("b.mark"))).select("b.node", "a.text")
    # rows that repeat an id and a text are one node
    sets = texts.mapInArrow(_sets(length), "node long, items binary").dropDuplicates(["node"])
    met = blocks.join(sets, "node").select("block", "side", "node", "root", "items")
    return met.groupBy("block").applyInArrow(_verified(percent), "u long, v long")


def _near(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of so many shingles can be near at all."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _parts() -> Column:
    """Into how many blocks rows with n shingles each go."""
    return F.greatest(F.ceil(F.count("*") / F.lit(BLOCK)), F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)))


def _roots(nodes: DataFrame, docs: DataFrame, length: int, percent: int) -> DataFrame:
    """(node, root) of the nodes that are linked with others."""
    rows = nodes.select("node", "n", F.posexplode("bands").alias("band", "key")).select("node", "n", F.xxhash64("band", "key").alias("key"))
    full = rows.groupBy("key").agg(F.count("*").alias("k"), F.min("node").alias("rep")).where("k > 1").select("key", "rep")
    full = stash(full, "minhash-buckets")
    met = stash(only_marked(rows, full, "key").join(full, "key"), "minhash-met")

    # star: every member against the least of its bucket, where sizes allow
    size = nodes.select(F.col("node").alias("rep"), F.col("n").alias("n_rep"))
    star = met.where("node != rep").groupBy("node", "rep").agg(F.min("n").alias("n")).join(size, "rep").where(_near(F.col("n"), F.col("n_rep"), percent))
    star = stash(star.select("node", "rep", "n"), "minhash-star")
    counts = star.groupBy("rep").agg(_parts().alias("parts"))
    star = star.join(counts, "rep").select("node", "rep", F.pmod(F.xxhash64("node"), F.col("parts")).alias("part"))
    block = F.xxhash64("rep", "part").alias("block")
    members = star.select(block, F.lit(1).alias("side"), "node", F.col("node").alias("root"))
    reps = star.select("rep", "part").distinct().select(block, F.lit(0).alias("side"), F.col("rep").alias("node"), F.col("rep").alias("root"))
    first = stash(_links(members.unionByName(reps), nodes, docs, length, percent), "minhash-links")
    linked = stash(components(first, "minhash-cc"), "minhash-roots")

    # buckets of several components that the star has not compared: blocks of like size that a bucket joins
    rest = met.where("node != rep").join(linked, "node", "left").select("key", "node", "n", "rep", F.coalesce("root", "node").alias("root"))
    open_ = rest.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("key")
    open_ = stash(open_, "minhash-open")
    rest = stash(only_marked(rest, open_, "key").join(open_, "key", "left_semi"), "minhash-rest")
    level = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(1.1))))
    # at most BANDS keys for each node, which stay with it instead of being joined again
    homes = rest.groupBy("node", "n", "root").agg(F.min("rep").alias("home"), F.collect_set("key").alias("keys")).withColumn("level", level)
    # a component of many nodes has blocks of its own, so that it is not compared with itself
    many = homes.groupBy("root").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK // 2).select("root", F.col("root").alias("own"))
    homes = homes.join(many, "root", "left").withColumn("own", F.coalesce("own", F.lit(-1)))
    counts = homes.groupBy("home", "level", "own").agg(_parts().alias("parts"))
    placed = homes.join(counts, ["home", "level", "own"]).select("node", "root", "own", "level", "keys", F.xxhash64("home", "level", "own", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("at"))
    placed = stash(placed, "minhash-placed")
    held = placed.select(F.explode("keys").alias("key"), "at", "own", "level").groupBy("key", "at").agg(F.min("own").alias("own"), F.min("level").alias("level"))
    held = stash(held, "minhash-held")
    a, b = (held.select("key", *[F.col(c).alias(f"{c}_{s}") for c in ("at", "own", "level")]) for s in "ab")
    apart = (F.col("own_a") == -1) | (F.col("own_a") != F.col("own_b"))
    levels = int(np.ceil(np.log(100 / percent) / np.log(1.1)))
    joined = a.join(b, "key").where((F.col("at_a") <= F.col("at_b")) & apart & (F.abs(F.col("level_a") - F.col("level_b")) <= levels))
    joined = stash(joined.select("at_a", "at_b").distinct(), "minhash-joined")
    sides = joined.select(F.xxhash64("at_a", "at_b").alias("block"), F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("at_a").alias("at")), F.struct(F.lit(1).alias("side"), F.col("at_b").alias("at")))).alias("x"), (F.col("at_a") == F.col("at_b")).alias("same"))
    sides = sides.where("not same or x.side = 0").select("block", "x.side", "x.at")
    blocks = sides.join(placed.select("at", "node", "root"), "at").select("block", "side", "node", "root")
    second = _links(stash(blocks, "minhash-blocks"), nodes, docs, length, percent)
    return components(first.unionByName(second), "minhash-cc")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row for each document: doc_id, n_shingles, component_id, kept.

    n_shingles counts the distinct runs of shingle words (A-Z as a-z; fewer
    words: the whole sequence is one). Documents are linked where 100 times the
    common shingles are percent times all of both or more; component_id is the
    smallest doc_id reachable, null ids passed over (null where all are). kept:
    whether the two are the same; false without an id. Null and empty texts have
    no shingles and no links. Rows that repeat an id and a text agree in all
    columns. Texts are read whole; other columns are left behind.
    """
    d = columns_of(docs, doc_id="long", text="string").withColumn("mark", F.xxhash64("text"))
    marks = stash(d.mapInArrow(_marked(shingle), _MARKS), "minhash-marks")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "mark")).alias("x")
    nodes = marks.where("n > 0").groupBy("h1", "h2", "n").agg(first, F.first("bands").alias("bands"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "n", F.col("x.doc_id").alias("least"), F.col("x.mark").alias("mark"), "bands")
    nodes = stash(nodes, "minhash-nodes")
    roots = stash(_roots(nodes, d, shingle, percent), "minhash-roots")
    rooted = nodes.join(roots, "node", "left").select("h1", "h2", "least", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.join(least, "root").select("h1", "h2", "component_id")
    found = marks.where("n > 0").join(rooted, ["h1", "h2"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = marks.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), d AS (
  SELECT id, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w
), sets AS (
  SELECT min(id) AS node, min(doc_id) AS least, any_value(s) AS s, len(any_value(s)) AS n FROM d WHERE len(s) > 0 GROUP BY list_sort(s)
), x AS (SELECT node, n, unnest(s) AS item FROM sets),
meets AS (
  SELECT a.node AS u, b.node AS v, a.n + b.n AS n, count(*) AS c FROM x a JOIN x b ON a.item = b.item AND a.node < b.node AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n) GROUP BY ALL
), links AS (SELECT u, v FROM meets WHERE 100 * c >= 80 * (n - c)),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT node AS u, node AS v FROM sets UNION SELECT r.u, w.v FROM reach r JOIN ways w ON r.v = w.u),
roots AS (SELECT u AS node, min(v) AS root FROM reach GROUP BY u),
named AS (SELECT s.node, s.s, min(s.least) OVER (PARTITION BY root) AS component_id FROM sets s JOIN roots r ON s.node = r.node),
of_set AS (SELECT list_sort(s) AS s, component_id FROM named)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE o.component_id END AS component_id,
       coalesce(d.doc_id = CASE WHEN len(d.s) = 0 THEN d.doc_id ELSE o.component_id END, false) AS kept
FROM d LEFT JOIN of_set o ON list_sort(d.s) = o.s
"""
