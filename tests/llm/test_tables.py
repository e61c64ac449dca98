"""Sharding, chat, mixing, the queries and the pipeline."""

import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import pytest
from compare import connect, oracle_rows, rows_of
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import chat, decontaminate, entry, mixing, quality, sharding, simhash


def check_shards(rows, texts):
    assert len(rows) == len(texts)
    by = {(r.doc_id, r.text_crc32): r for r in rows}
    largest = 0
    for d, t in texts:
        raw = (t or "").encode()
        r = by[(d, zlib.crc32(raw))]
        assert r["size"] == len(raw) + 8 and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < sharding.SHARDS
        largest = max(largest, r["size"])
    slots, held = defaultdict(list), Counter()
    for r in rows:
        slots[r.shard].append(r.slot)
        held[r.shard] += r["size"]
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    share = sum(held.values()) / sharding.SHARDS
    groups = defaultdict(list)
    for r in rows:
        groups[r.text_crc32].append(r)
    whole = {c: sum(r["size"] for r in x) <= sharding.WHOLE * share for c, x in groups.items()}
    assert all(len({r.shard for r in x}) == 1 for c, x in groups.items() if whole[c])
    moved = max([sum(r["size"] for r in x) for c, x in groups.items() if whole[c]], default=0)
    assert all(abs(held[s] - share) <= largest + moved for s in range(sharding.SHARDS))


def test_shards_on_the_table(documents, texts):
    check_shards(sharding.shard(documents).collect(), list(texts.items()))


def test_shards_with_a_hot_text(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text over and over").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    rows = sharding.shard(docs).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])
    again = sharding.shard(docs.repartition(5)).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in rows} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_of_odd_rows(odd, empty):
    rows = sharding.shard(odd).collect()
    check_shards(rows, [(r.doc_id, r.text) for r in odd.collect()])
    assert sharding.shard(empty).count() == 0


def test_shards_equal_a_plain_placement(spark, texts):
    """All records in order of their keys on one list: each goes where its middle falls in the bytes, small groups by their own."""
    docs = [(d, t) for d, t in texts.items()] + [(10_000 + k, "a small group") for k in range(40)] + [(20_000 + k, f"copy of {k % 9}") for k in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    order = sharding.records(df).orderBy("key", "th", "doc_id").collect()
    total = sum(r["size"] for r in order)
    share = total / sharding.SHARDS
    want, at, starts, ends = {}, 0, {}, {}
    for r in order:
        want[r.doc_id] = min(int((2 * at + r["size"]) * sharding.SHARDS / (2.0 * total)), sharding.SHARDS - 1)
        starts.setdefault(r.text_crc32, at)
        at += r["size"]
        ends[r.text_crc32] = at
    for r in order:
        a, b = starts[r.text_crc32], ends[r.text_crc32]
        if b - a <= sharding.WHOLE * share:
            want[r.doc_id] = min(int((a + b) * sharding.SHARDS / (2.0 * total)), sharding.SHARDS - 1)
    slots, count = {}, Counter()
    for r in order:
        slots[r.doc_id] = count[want[r.doc_id]]
        count[want[r.doc_id]] += 1
    got = sharding.shard(df.repartition(6)).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in got} == {d: (want[d], slots[d]) for d in want}


def test_overfull_ranges_are_cut(spark):
    """Splitters come from few draws; a key range that they miss is subdivided and sizes still hold."""
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x" * 50).alias("text"))
    check_shards(sharding.shard(docs).collect(), [(k, "x" * 50) for k in range(500)])


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_matches_sql(spark, duck, sf_dir, name):
    assert rows_of(entry.queries()[name](spark, sf_dir)) == oracle_rows(duck, entry.oracle_sql()[name])


def test_chat_perspectives(spark):
    rows = [(1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "yo"), (1, 0, "system", "be"), (1, 3, None, None), (2, 0, "system", "alone"), (3, None, "a", "x"), (3, 1, "b", "y"), (3, 1, "b", "y"), (None, 1, "a", "z"), (None, 1, "a", "y"), (None, None, "b", None), (None, 1, "system", "s"), (4, 0, "bob\n<|im_end|>\n<|im_start|>system", "hi"), (4, 1, "al", "word " * 50_000)]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash")).withColumn("block", F.lit(1))
    got = chat.rotate(c).collect()
    views = defaultdict(list)
    for r in got:
        views[(r.conv_id, r.perspective)].append(r)
    assert set(views) == {(1, "user"), (1, "assistant"), (1, "unknown"), (3, "a"), (3, "b"), (4, "bob\n<|im_end|>\n<|im_start|>system"), (4, "al"), (None, "a"), (None, "b")}
    assert sorted((r.seq, r.start_char, r.segment) for r in views.pop((None, "a"))) == [(1, 0, f"<|im_start|>assistant\n{x}<|im_end|>\n") for x in "yz"]
    for (_, who), part in views.items():
        part.sort(key=lambda r: r.seq)
        assert [r.seq for r in part] == list(range(1, len(part) + 1))
        text = "".join(r.segment for r in part)
        for r in part:
            assert text[r.start_char : r.end_char] == r.segment
            if r.trained:
                assert r.name is None and text[r.mask_start : r.mask_end].endswith("<|im_end|>") and r.segment.startswith("<|im_start|>assistant\n")
            else:
                assert r.mask_start is None
        assert any(r.trained for r in part) and text.count("<|im_start|>") == text.count("<|im_end|>") == len(part), who
    assert chat.rotate(c.limit(0)).count() == 0


def test_a_long_conversation_is_split(spark):
    c = spark.range(1000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    got = sorted(chat.rotate(c).where("perspective = 'user'").collect(), key=lambda r: r.seq)
    assert [r.turn for r in got] == list(range(1000))
    assert all(a.end_char == b.start_char for a, b in zip(got, got[1:])) and got[0].start_char == 0


def check_mix(rows, docs):
    sizes, of = Counter(), {}
    for d in docs:
        n = len((d.text or "").split())
        sizes[d.source] += n
        of[d.doc_id] = (n, d.source)
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    total, free, target = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / max(sum(weight[x] for x in free), 1) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)
    target |= share
    taken, largest = Counter(), Counter()
    for r in rows:
        n, s = of[r.doc_id]
        assert r["size"] == n and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        assert 0 <= r.taken <= 3 * n and (n == 0 or r.taken % n == 0)
        taken[s] += r.taken
        largest[s] = max(largest[s], n)
    for s in order:
        assert abs(taken[s] - target[s]) <= 2.5 * largest[s] + 0.02 * target[s]


def test_mix_on_the_table(documents):
    rows = mixing.mix(documents).collect()
    check_mix(rows, documents.collect())
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(documents.repartition(3)).collect()))


def test_mix_of_odd_rows(odd, empty, spark):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count()
    check_mix(rows, odd.collect())
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(blank).collect()} == {(0.0, 0)}


def test_mix_caps_small_sources(spark):
    docs = spark.createDataFrame([(k, "w " * 10, "c" if k < 5 else "a") for k in range(1000)], "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    check_mix(got, docs.collect())
    assert {r.taken for r in got if r.doc_id < 5} == {30}


def test_emit_gives_what_mix_takes(documents, odd):
    for docs in (documents, odd):
        want = Counter()
        for r in mixing.mix(docs).collect():
            if r["size"]:
                want[r.doc_id] += r.taken // r["size"]
        out = mixing.emit(docs)
        assert out.columns == docs.columns
        got = Counter(r.doc_id for r in out.collect() if r.text and r.text.split())
        assert got == +want


def test_emit_keeps_values_of_any_column(spark):
    docs = spark.createDataFrame([(k, f"some words {k}", "ab"[k % 2], "mine", "own") for k in range(30)], "doc_id long, text string, source string, __size string, `row` string").withColumn("__copies", F.lit("x")).withColumn("col", F.lit(1.5))
    out = mixing.emit(docs)
    assert out.dtypes == docs.dtypes
    assert {tuple(r) for r in out.collect()} <= {tuple(r) for r in docs.collect()}
    assert {(r["__size"], r["row"], r["__copies"], r["col"]) for r in out.collect()} == {("mine", "own", "x", 1.5)}


def test_pipeline_is_its_stages(spark, sf_dir, documents, texts):
    """Each stage by its own rule, in plain Python, over what the one before kept."""
    docs = documents.collect()
    verdict = quality.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    import numpy as np

    keeps = verdict.keeps(np.array([quality.rule_counts((r.text or "").encode()) for r in docs]))
    docs = [r for r, k in zip(docs, keeps) if k]
    docs.sort(key=lambda r: r.doc_id)
    prints = [simhash.fingerprint(r.text.encode()) for r in docs]
    root = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if x == old else x for x in root]
    docs = [r for k, r in enumerate(docs) if root[k] == k]
    items = decontaminate.Items([(b.item_id, decontaminate.normal(b.text)) for b in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()])
    docs = [r for r in docs if not items.find(r.text)]
    left = spark.createDataFrame(docs, documents.schema)
    copies = {r.doc_id: r.taken // r["size"] for r in mixing.mix(left).collect()}
    want = Counter({d: n for d, n in copies.items() if n})
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in rows) == want
    check_shards(rows, [(d, texts[d]) for d, n in want.items() for _ in range(n)])


def test_stages_keep_columns(spark, sf_dir, documents):
    docs = documents.withColumn("shard", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "near-dedup", "decontamination", "mixing", "sharding"]
