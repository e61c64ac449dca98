"""Repeated passages by a sparse suffix array.

Suffixes are retained only where a minimiser of the text lies: the least hash
of GRAM words within SPAN neighbouring grams. Any passage of PASSAGE words
holds such a position within its first SPAN grams, the same in every copy, and
at least REACH words of the passage follow it. So:

1. each retained suffix is represented by the hash of its first REACH words and
   the hash of all that a passage around it can hold (its context: SPAN - 1
   words to the left, PASSAGE to the right, or to the text's ends);
2. suffixes are range-sorted by both and compared with their neighbours. One
   whose first words differ from both neighbours' has no partner and goes. One
   whose context equals a neighbour's is extended over all of it, and needs its
   text no more;
3. those between others of the same first words but of another context, and one
   of each class of equal contexts beside them, are extended in their texts word
   by word: each passage of PASSAGE words around them, from the farthest left to
   the farthest right, is compared across the corpus by 128 bits. What one of a
   class finds holds for all of it, and whom it finds are all of another class.
   Overlapping and touching passages of a document are one span.

Every step costs in proportion to the text, however large a group of copies is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, drop, only_marked, raw_texts, stash

PASSAGE, GRAM, SPAN = 50, 10, 30
REACH = PASSAGE - SPAN + 1
_M, _M2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Stands for words beyond a text's ends.
_BEYOND = np.uint64(0xA0761D6478BD642F)


class _Words:
    """Hashes of words, kept while there are not too many."""

    def __init__(self, most: int = 300_000):
        self.known: dict[bytes, int] = {}
        self.most = most

    def __call__(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.most:
            self.known.clear()
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, 7)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _windows(hashes: np.ndarray, *lengths: int, by: int = _M) -> list[np.ndarray]:
    """For each length the hash of every run of so many words, by doubling."""
    doubled, factor = [hashes], [by]
    while 2 << len(doubled) - 1 <= max(lengths):
        k = 1 << len(doubled) - 1
        last = doubled[-1]
        doubled.append(last[:-k] + np.uint64(factor[-1]) * last[k:])
        factor.append(factor[-1] ** 2 % 2**64)
    out = []
    for length in lengths:
        total, at, scale = None, 0, 1
        count = len(hashes) - length + 1
        for k in reversed(range(len(doubled))):
            if length >> k & 1:
                part = doubled[k][at : at + count]
                total = part.copy() if total is None else total + np.uint64(scale) * part
                at, scale = at + (1 << k), scale * factor[k] % 2**64
        out.append(total)
    return out


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(29)


def _extreme(x: np.ndarray, width: int, pick) -> np.ndarray:
    """The least or greatest of every width neighbours."""
    count, k = len(x) - width + 1, 1
    while 2 * k <= width:
        x = pick(x[:-k], x[k:])
        k *= 2
    return pick(x[:count], x[width - k : width - k + count])


def _marks(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram ranks, least rank of each window of SPAN grams, retained positions)."""
    rank = _spread(_windows(hashes, GRAM)[0])
    least = _extreme(rank, SPAN, np.minimum)
    padded = np.concatenate([np.zeros(SPAN - 1, np.uint64), least, np.zeros(SPAN - 1, np.uint64)])
    retained = np.flatnonzero(_extreme(padded, SPAN, np.maximum) == rank)
    return rank, least, retained[retained + REACH <= len(hashes)]


class _Rows:
    """Collects columns of int64 and int32 and gives them as batches of bounded size."""

    def __init__(self, **kinds: type):
        self.kinds, self.parts, self.n = kinds, {k: [] for k in kinds}, 0

    def add(self, count: int, **columns) -> None:
        for k, x in columns.items():
            self.parts[k].append(pa.array(x.astype(self.kinds[k], copy=False)) if isinstance(x, np.ndarray) else pa.repeat(pa.scalar(x, pa.int64()), count))
        self.n += count

    def taken(self) -> pa.RecordBatch:
        arrays = [pa.concat_arrays(p) if p else pa.array(np.zeros(0, self.kinds[k])) for k, p in self.parts.items()]
        self.parts, self.n = {k: [] for k in self.kinds}, 0
        return pa.RecordBatch.from_arrays(arrays, list(self.kinds))


_SUFFIX = dict(key=np.int64, ext=np.int64, doc_id=np.int64, mark=np.int64, at=np.int32, size=np.int32)
_SUFFIX_SQL = "key long, ext long, doc_id long, mark long, at int, size int"


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """size is the text's length in words."""
    hashed, rows = _Words(), _Rows(**_SUFFIX)
    left, right = np.full(SPAN - 1, _BEYOND), np.full(PASSAGE, _BEYOND)
    for batch in batches:
        for doc, mark, raw in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), raw_texts(batch.column("text"))):
            words = (raw or b"").split()
            if len(words) < PASSAGE:
                continue
            h = hashed(words)
            at = _marks(h)[2]
            context = _windows(np.concatenate([left, h, right]), SPAN - 1 + PASSAGE, by=_M2)[0]
            rows.add(len(at), key=_spread(_windows(h, REACH)[0])[at].view(np.int64), ext=_spread(context)[at].view(np.int64), doc_id=doc, mark=mark, at=at, size=np.full(len(at), len(h)))
            if rows.n > 200_000:
                yield rows.taken()
    yield rows.taken()


WHOLE, BESIDE, LAST = range(3)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted suffixes and their neighbours: (doc_id, mark, at, size, sort, first, key, ext).

    first is the least id of the class in this partition. That is the least of
    all, for a class is in order of ids, unless it is the partition's first and
    goes on from another. WHOLE: the context equals a neighbour's. LAST: the
    partition's last class; one row. BESIDE: to be extended in the text. A partition's first and last suffix
    may have their equals in the next one and always are. A suffix may give a row
    of each sort.
    """
    held, before = None, None  # the last row, not given yet, and what is known of the one before it
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        key, ext = t.column("key").to_numpy(), t.column("ext").to_numpy()
        n = len(key)
        # of each row: does the one before it have the same first words, the same context
        near, same = np.zeros(n, bool), np.zeros(n, bool)
        near[1:], same[1:] = key[1:] == key[:-1], (key[1:] == key[:-1]) & (ext[1:] == ext[:-1])
        begins = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        ids = t.column("doc_id")
        heads = ids.take(pa.array(begins))
        if before is not None:
            near[0], same[0], head, edge = before
            if same[0]:  # its class began in an earlier batch
                end = n if same[1:].all() else int(np.argmin(same[1:])) + 1
                heads = pa.concat_arrays([pa.repeat(pa.scalar(head, pa.int64()), end), heads.slice(end)])
        else:
            edge = True
        # the last row waits for the one that follows it
        own = np.arange(n - 1)
        whole = same[own] | same[own + 1]
        beside = (near[own] & ~same[own]) | (near[own + 1] & ~same[own + 1])
        if edge and n > 1:
            beside[0] = True  # a partition's first row
        yield from _told(t, heads, np.flatnonzero(whole), np.flatnonzero(beside))
        held, before = t.slice(n - 1), (near[n - 1], same[n - 1], heads[n - 1].as_py(), edge and n == 1)
    if held is not None:
        near, same, head, _ = before
        yield from _told(held, pa.array([head], pa.int64()), np.flatnonzero([same]), np.zeros(1, int), last=True)


def _told(t: pa.RecordBatch, heads: pa.Array, whole: np.ndarray, beside: np.ndarray, last: bool = False) -> Iterator[pa.RecordBatch]:
    for rows, sort in ((whole, WHOLE), (beside, BESIDE), (np.zeros(int(last), int), LAST)):
        if len(rows):
            at = pa.array(rows)
            told = [*[t.column(c).take(at) for c in ("doc_id", "mark", "at", "size")], pa.array(np.full(len(rows), sort, np.int8)), heads.take(at), *[t.column(c).take(at) for c in ("key", "ext")]]
            yield pa.RecordBatch.from_arrays(told, ["doc_id", "mark", "at", "size", "sort", "first", "key", "ext"])


_WINDOW = dict(k1=np.int64, k2=np.int64, doc_id=np.int64, mark=np.int64, at=np.int32, place=np.int32)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All passages for which one of the places is the minimiser, by two hashes."""
    hashed, rows = _Words(), _Rows(**_WINDOW)
    for batch in batches:
        for doc, mark, raw, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("mark").to_pylist(), raw_texts(batch.column("text")), batch.column("places").to_pylist()):
            h = hashed(raw.split())
            rank, least, retained = _marks(h)
            starts = np.arange(len(h) - PASSAGE + 1)
            need = least[: len(starts)]
            k = np.searchsorted(retained, starts)
            while len(off := np.flatnonzero(rank[retained[k]] != need)):
                k[off] += 1  # the leftmost minimum of the window
            chosen = starts[np.isin(retained[k], wanted)]
            k1, k2 = (_spread(_windows(h, PASSAGE, by=m)[0])[chosen].view(np.int64) for m in (_M, _M2))
            rows.add(len(chosen), k1=k1, k2=k2, doc_id=doc, mark=mark, at=chosen, place=retained[k][chosen])
            if rows.n > 200_000:
                yield rows.taken()
    yield rows.taken()


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, covered = [], []
        for parts in batch.column("parts").to_pylist():
            joined: list[list[int]] = []
            for p in sorted((p["a"], p["b"]) for p in parts):
                if joined and p[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], p[1])
                else:
                    joined.append(list(p))
            spans.append(",".join(f"{x}:{y}" for x, y in joined))
            covered.append(sum(y - x for x, y in joined))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("first_doc_id"), pa.array([x.count(",") + 1 for x in spans], pa.int32()), pa.array(covered, pa.int64()), pa.array(spans, pa.string())], ["doc_id", "first_doc_id", "n_spans", "n_words", "spans"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row for each document with passages of PASSAGE words or more that occur elsewhere too.

    doc_id; first_doc_id, the smallest id among the documents that share one of
    them (itself included); n_spans, n_words and spans (start:end in words, end
    exclusive, by start). Elsewhere is another document, another place of the
    same one, or a row that repeats it. Words are runs of anything but ASCII
    white space and must be equal to the byte. Null, empty and shorter texts
    have no rows; rows that repeat doc_id and text give one row.
    """
    docs = columns_of(docs, doc_id="long", text="string").where("text is not null").withColumn("mark", F.xxhash64("text"))
    suffixes = stash(docs.mapInArrow(_suffixes, _SUFFIX_SQL), "suffixes")
    order = ["key", "ext", F.col("doc_id").asc_nulls_last(), "at"]
    ordered = suffixes.repartitionByRange(*order).sortWithinPartitions(*order)
    told = stash(ordered.mapInArrow(_compared, "doc_id long, mark long, at int, size int, sort byte, first long, key long, ext long"), "suffix-neighbours")
    drop(suffixes)

    # a class that began in an earlier partition has its least id from there (a row for each partition, so that the table is bounded)
    least = told.where(F.col("sort") == LAST).groupBy("key", "ext").agg(F.min("first").alias("least"))
    known = told.where(F.col("sort") != LAST).join(F.broadcast(least), ["key", "ext"], "left").withColumn("first", F.coalesce("least", "first")).drop("least")

    # extended over the whole context
    part = F.struct(F.greatest(F.col("at") - (SPAN - 1), F.lit(0)).alias("a"), F.least(F.col("at") + PASSAGE, F.col("size")).alias("b"))
    whole = known.where(F.col("sort") == WHOLE).select("key", "ext", "doc_id", "mark", "first", part.alias("part"))

    # extended in the text
    beside = known.where(F.col("sort") == BESIDE)
    places = beside.groupBy("doc_id", "mark").agg(F.collect_set("at").alias("places"))
    a, b = only_marked(docs, beside, "mark").alias("a"), places.alias("b")
    left = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.mark") == F.col("b.mark"))).select("a.doc_id", "a.mark", "a.text", "b.places")
    windows = stash(left.mapInArrow(_extended, "k1 long, k2 long, doc_id long, mark long, at int, place int"), "suffix-windows")
    # a table of its own: both sides of the join are then plain exchanges, and Spark can split a hot key
    twice = stash(windows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "suffix-repeats")
    some = stash(windows.join(twice, ["k1", "k2"]), "suffix-found")

    # a passage's first is the least id of all classes that hold it, and every one of these classes shares it
    w, c = some.alias("w"), beside.alias("c")
    own = w.join(c, F.col("w.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("w.mark") == F.col("c.mark")) & (F.col("w.place") == F.col("c.at")))
    own = own.select("w.k1", "w.k2", "w.doc_id", "w.mark", F.col("w.at").alias("at"), "c.key", "c.ext", "c.first")
    own = stash(own, "suffix-owners")
    firsts = own.groupBy("k1", "k2").agg(F.min("first").alias("least"))
    told_of = stash(own.join(firsts, ["k1", "k2"]), "suffix-firsts")
    part = F.struct(F.col("at").alias("a"), (F.col("at") + PASSAGE).alias("b"))
    spans = told_of.select("doc_id", "mark", F.col("least").alias("first"), part.alias("part"))
    classes = told_of.groupBy("key", "ext").agg(F.min("least").alias("least"))
    classes = stash(classes, "suffix-classes")
    learned = only_marked(whole, classes, "key").join(classes, ["key", "ext"]).select("doc_id", "mark", F.col("least").alias("first"), "part")
    found = whole.drop("key", "ext").unionByName(learned).unionByName(spans).groupBy("doc_id", "mark").agg(F.min("first").alias("first_doc_id"), F.collect_set("part").alias("parts"))
    return found.drop("mark").mapInArrow(_merged, "doc_id long, first_doc_id long, n_spans int, n_words long, spans string")


#: Windows of PASSAGE words that occur twice, and the least id among the documents that hold one of them.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)
), windows AS (
  SELECT id, doc_id, i - 1 AS pos, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)
), twice AS (SELECT k, min(doc_id) AS first FROM windows GROUP BY k HAVING count(*) > 1),
found AS (SELECT w.id, w.doc_id, w.pos, t.first FROM windows w JOIN twice t ON w.k = t.k),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER o + 50 THEN 0 ELSE 1 END AS opens FROM found WINDOW o AS (PARTITION BY id ORDER BY pos)),
runs AS (SELECT *, sum(opens) OVER (PARTITION BY id ORDER BY pos) AS run FROM marked),
spans AS (SELECT id, doc_id, run, min(pos) AS a, max(pos) + 50 AS b, min(first) AS first FROM runs GROUP BY ALL)
SELECT doc_id, min(first) AS first_doc_id, CAST(count(*) AS INTEGER) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_words, string_agg(a || ':' || b, ',' ORDER BY a) AS spans
FROM spans GROUP BY id, doc_id
"""
