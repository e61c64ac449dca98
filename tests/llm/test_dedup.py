"""Suffix-array dedup and SimHash against brute force."""

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from samples import prose
from pyspark.sql import functions as F

from tracemill.llm import common, simhash, suffix_dedup


def repeats(docs: list[tuple]) -> dict:
    """id -> covered word positions: all 50-word windows that occur twice."""
    seen = defaultdict(list)
    for k, (_, text) in enumerate(docs):
        w = (text or "").encode().split()
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].append((k, i))
    out = defaultdict(set)
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                out[docs[k][0]].update(range(i, i + 50))
    return dict(out)


def spans(df) -> dict:
    out = {}
    for r in df.collect():
        cover = set()
        for s in r.spans.split(","):
            a, b = map(int, s.split(":"))
            cover.update(range(a, b))
        assert r.n_words == len(cover) and r.n_spans == r.spans.count(",") + 1
        out[r.doc_id] = cover
    return out


def test_passages_on_the_table(documents, texts):
    assert spans(suffix_dedup.repeated_passages(documents)) == repeats(list(texts.items()))


def test_passages_at_every_offset(spark):
    shared = prose(51, 99)
    docs = [(k, f"{prose(k * 3, 200 + k)} {shared} {prose(40 - k, 300 + k)}") for k in range(30)] + [(100, prose(300, 400)), (101, prose(49, 99)), (102, "again " * 120)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = suffix_dedup.repeated_passages(df)
    assert spans(got) == repeats(docs)
    assert {r.first_doc_id for r in got.where("doc_id < 30").collect()} == {0}


def test_passages_of_odd_rows(odd, empty):
    got = spans(suffix_dedup.repeated_passages(odd))
    assert set(got) == {6, 7} and got[6] == set(range(120))
    assert suffix_dedup.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_neighbours_across_batches(size):
    """Runs of equal keys and contexts that end, begin or lie anywhere at a batch's border."""
    rng = np.random.RandomState(size)
    for _ in range(80):
        keys = np.repeat(np.arange(8), rng.randint(1, 6, 8))
        exts = np.concatenate([np.sort(rng.randint(0, 3, (keys == k).sum())) for k in range(8)])
        n = len(keys)
        ids = [None if x == 9 else x for x in rng.randint(0, 10, n).tolist()]
        classes = list(zip(keys.tolist(), exts.tolist()))
        for c in set(classes):  # within a class by id, null last
            at = [k for k in range(n) if classes[k] == c]
            for k, x in zip(at, sorted((ids[k] for k in at), key=lambda x: (x is None, x))):
                ids[k] = x
        rows = pa.RecordBatch.from_pydict({"key": keys, "ext": exts.astype(np.int64), "doc_id": pa.array(ids, pa.int64()), "mark": np.arange(n), "at": np.arange(n, dtype=np.int32), "size": np.full(n, 99, np.int32)})
        got = [r for b in suffix_dedup._compared(rows.slice(k, size) for k in range(0, n, size)) for r in b.to_pylist()]
        whole = {r["at"]: r for r in got if r["sort"] == suffix_dedup.WHOLE}
        assert len(whole) == sum(r["sort"] == suffix_dedup.WHOLE for r in got) and set(whole) == {k for k in range(n) if classes.count(classes[k]) > 1}
        assert all(r["first"] == ids[classes.index(classes[k])] for k, r in whole.items())
        assert all((r["key"], r["ext"]) == classes[r["at"]] for r in got)
        assert [(r["key"], r["ext"], r["first"]) for r in got if r["sort"] == suffix_dedup.LAST] == [(*classes[-1], ids[classes.index(classes[-1])])]
        other = lambda k, j: 0 <= j < n and keys[j] == keys[k] and exts[j] != exts[k]
        assert [r["at"] for r in got if r["sort"] == suffix_dedup.BESIDE] == [k for k in range(n) if k in (0, n - 1) or other(k, k - 1) or other(k, k + 1)]


def test_a_class_that_partitions_share_has_its_least_id(spark):
    shared, more = prose(400, 61), prose(30, 62)
    docs = [(k, f"{shared}") for k in range(300, 0, -1)] + [(None, shared), (0, f"{prose(45, 63)} {shared} {more}")]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(9))
    assert {r.first_doc_id for r in got.collect()} == {0} and spans(got) == repeats(docs)


def firsts(docs: list[tuple]) -> dict:
    """id -> the least id of the documents that hold one of its 50-word windows."""
    seen = defaultdict(set)
    for d, text in docs:
        w = text.encode().split()
        for i in range(len(w) - 49):
            seen[tuple(w[i : i + 50])].add((d, i))
    out: dict = {}
    for places in seen.values():
        if len(places) > 1:
            for d, _ in places:
                out[d] = min(out.get(d, d), *(p[0] for p in places))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_first_ids_reach_all_of_a_class(spark, seed):
    """Equal documents and others that share a part of them, with ids in any order."""
    rng = np.random.RandomState(seed)
    base = [prose(140, 900 + k) for k in range(3)]
    docs = []
    for k in rng.permutation(40).tolist():
        w = base[k % 3].split()
        cut = int(rng.randint(0, 80))
        docs.append((k, " ".join(w) if k % 4 else f"{prose(20 + k, 950 + k)} {' '.join(w[cut : cut + 58])} {prose(30, 990 + k)}"))
    got = suffix_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    assert {r.doc_id: r.first_doc_id for r in got.collect()} == firsts(docs)


def test_first_ids_on_the_table(documents, texts):
    got = suffix_dedup.repeated_passages(documents)
    assert {r.doc_id: r.first_doc_id for r in got.collect()} == firsts([(d, t or "") for d, t in texts.items()])


def test_windows_are_hashes_of_runs():
    h = np.random.RandomState(1).randint(0, 2**63, 200).astype(np.uint64)
    for n, got in zip((10, 31, 50), suffix_dedup._windows(h, 10, 31, 50)):
        power = [pow(suffix_dedup._M, j, 2**64) for j in range(n)]
        assert [int(x) for x in got] == [sum(int(h[i + j]) * power[j] for j in range(n)) % 2**64 for i in range(len(h) - n + 1)]


def plain_fingerprint(text) -> int:
    w = [x for x in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if x]
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(prints: list[int]) -> list[int]:
    """Position of the first member of each fingerprint's component."""
    at = list(range(len(prints)))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                at[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(prints))]


def test_simhash_on_the_table(documents, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(documents).collect()}
    ids = sorted(texts)
    prints = [plain_fingerprint(texts[d]) for d in ids]
    assert [got[d].fingerprint for d in ids] == [f"{p:016x}" for p in prints]
    assert [got[d].component_id for d in ids] == [ids[k] for k in roots(prints)]
    assert got[ids[0]].__fields__ == ["doc_id", "fingerprint", "component_id"]


def test_pivot_cells_lose_no_pair():
    """Coordinates over some three parts agree at every pivot for any two flips; over all bits they differ by two at most."""
    rng = np.random.RandomState(3)
    for _ in range(500):
        a = int(rng.randint(0, 2**62)) << 2 | int(rng.randint(4))
        b = a ^ sum(1 << int(f) for f in rng.choice(64, rng.randint(1, 3), replace=False))
        at = lambda x, mask: [((x ^ p) & mask & (2**64 - 1)).bit_count() for p in simhash.PIVOTS]
        assert any(at(a, m) == at(b, m) for m in simhash.MASKS)
        assert max(abs(x - y) for x, y in zip(at(a, -1), at(b, -1))) <= simhash.RADIUS
    assert sorted((m % 2**64).bit_count() for m in simhash.MASKS)[0] >= 36


@pytest.mark.parametrize("cell", [2, 24])
def test_links_connect_what_is_near(spark, monkeypatch, cell):
    """Balls of fingerprints around some centres, with pairs on and off the radius; cells paired or starred."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = np.random.RandomState(5)
    prints = set()
    for _ in range(12):
        c = int(rng.randint(0, 2**62)) << 1
        for _ in range(30):
            flips = rng.choice(64, rng.randint(0, 5), replace=False)
            prints.add(c ^ sum(1 << int(f) for f in flips))
    prints = sorted(prints)
    nodes = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    got = {r.node: r.root for r in common.components(simhash.links(nodes)).collect()}
    signed = [simhash._signed(p) for p in prints]
    want = roots(prints)
    least = defaultdict(list)
    for k, r in enumerate(want):
        least[r].append(signed[k])
    assert [got.get(s, s) for s in signed] == [min(least[r]) for r in want]


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 400), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in common.components(chain).collect()}
    assert got == {k: 0 for k in range(1, 201)} | {500: 400}
    assert common.components(chain.limit(0)).count() == 0


def test_simhash_of_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add(r.component_id)
    assert by[1] == by[2] == by[3] == {1} and by[6] == by[7] == {6} and by[None] == {None}
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, k) for k in (1, 4, 5, 6, 8, 9)] + [(True, None)]
    assert simhash.keep_one(empty).count() == 0


def test_keep_one_is_one_of_each(documents):
    marks = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents).collect()}
    kept = [r.doc_id for r in simhash.keep_one(documents.withColumn("more", F.lit(1))).collect()]
    assert sorted(kept) == sorted(set(marks.values()))


def test_keep_one_carries_columns_of_any_name(spark):
    a, b = prose(80, 801), prose(80, 802)
    docs = spark.createDataFrame([(1, a, "p", 1, "u"), (2, a, "q", 2, "v"), (3, b, "r", 3, "w"), (3, b, "r", 3, "w")], "doc_id long, text string, __id string, mark int, `row` string").withColumns({c: F.lit("mine") for c in ("id", "of", "own", "more", "nth", "a.b")})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(1, a, "p", 1, "u", *["mine"] * 6), (3, b, "r", 3, "w", *["mine"] * 6)]


def test_keep_one_of_components_that_share_an_id(spark):
    """Null ids of different texts, a null-id copy beside an id, and an id on two unrelated texts."""
    a, b, c, d, e, f = (prose(80, 700 + k) for k in range(6))
    docs = [(None, a), (None, a), (None, b), (None, c), (3, c), (4, c), (5, d), (5, e), (5, e), (9, e), (None, f), (2, f)]
    kept = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, [(None, a), (None, b), (3, c), (5, d), (5, e), (2, f)]))
