"""Stored tables: search by bitmaps, many changes at once; parsers by their claims; refined columns."""

import random

import pytest
from pyspark.sql import functions as F

from tracemill.operators import detect, schema, search_index, tables
from tracemill.plans import engine
from tracemill.plans.catalog import Catalog
from tracemill.sources import files as sources
from tracemill.sources.lines import lines_of
from tracemill.streaming import stores

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    r = random.Random(3)
    rows = [(k, " ".join(r.choice(WORDS) for _ in range(6)) + (" Needle-42" if k == 777 else ""), None if k % 5 else "q\"uote") for k in range(1000)]
    df = spark.createDataFrame(rows, "id long, line string, note string")
    path = str(tmp_path_factory.mktemp("index"))
    search_index.write(df, path, "id", 50)
    return df, path


@pytest.mark.parametrize("text", ["needle-42", "NEEDLE", "alpha beta", "eta", "a", "  ", "uote", "line", "nothing like it", "null", "777"])
def test_search_by_bitmaps_equals_a_scan(spark, stored, text):
    df, path = stored
    assert sorted(r.id for r in search_index.search(spark, path, text).collect()) == sorted(r.id for r in tables.search(df, text).collect())


def test_a_rare_word_reads_few_blocks(spark, stored):
    df, path = stored
    assert spark.read.parquet(f"{path}/rows").select(search_index.BLOCK).distinct().count() == 20
    assert search_index.blocks(spark, path, "needle-42").count() <= 2 and search_index.blocks(spark, path, "alpha").count() == 20
    plan = search_index.search(spark, path, "needle-42")._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_many_changes_are_one_write(spark):
    c = Catalog(spark, "many_changes")
    c.create("t", spark.range(1000).select(F.col("id").alias("k"), F.lit("old").alias("s"), F.lit(1.5).alias("v")))
    ids = {r.k: r.id for r in c.table("t").select("k", "id").collect()}
    r = random.Random(5)
    changes, want = [], {k: ("old", 1.5) for k in ids}
    for seq in range(1200):
        k = r.randrange(400)
        values = {n: v for n, v in (("s", f"new{seq}"), ("v", str(seq / 2)), ("no_column", "x")) if r.random() < 0.5}
        gone = r.random() < 0.05
        changes.append((ids[k], seq, gone, values))
        if gone:
            want[k] = None
        elif want[k] is not None:
            want[k] = (values.get("s", want[k][0]), float(values.get("v", want[k][1])))
    changes += [("unknown id", 5000, False, {"s": "x"}), (None, 5001, True, None), (ids[999], 5002, False, {"s": None}), (ids[998], 5003, False, None)]
    want[999] = (None, 1.5)
    c.change("t", spark.createDataFrame(changes, "id string, seq long, deleted boolean, values map<string,string>"))
    assert {x.k: (x.s, x.v) for x in c.table("t").collect()} == {k: v for k, v in want.items() if v}
    assert {x.id for x in c.table("t").collect()} <= set(ids.values())
    assert [x for x in c.discover() if x["table_name"] == "t"] == [{"table_name": "t", "columns": ["k", "s", "v", "id"], "row_count": sum(v is not None for v in want.values())}]
    c.drop("t")


SYSLOG = "\n".join(f"<34>Oct 11 22:14:{k:02d} host app[{k}]: message {k}" for k in range(20))
FILES = [
    ("a.json", '{"a": 1}'),
    ("b.tsv", "x\ty\n1\t2"),
    ("c.xml", "<a><b>1</b></a>"),
    ("d.log", "free text\nof no kind"),
    ("e.txt", SYSLOG),
    ("f.hex", "no dump"),
    ("g.bin", "\n".join(f"{k:08x}  41 42 43 44 45 46 47 48 49 4a 4b 4c 4d 4e 4f 50  |ABCDEFGHIJKLMNOP|" for k in range(5))),
    ("h", "free text\nof no kind"),
    ("i.csv", ""),
    ("j", ""),
]


def test_every_parser_makes_its_claim(spark):
    files = sources.inline_files(spark, FILES)
    got = detect.discovered(files, lines_of(files)).collect()
    assert len(got) == len(FILES) * 10
    best = {FILES[int(r.file_id)][0]: (r.parser_key, r.supported, r.score) for r in got if r.rank == 0}
    assert {k: best[k] for k in ("a.json", "b.tsv", "c.xml", "d.log", "f.hex", "i.csv", "j")} == {"a.json": ("json_lines", True, 1.0), "b.tsv": ("csv", True, 0.95), "c.xml": ("xml", True, 0.95), "d.log": ("syslog", True, 0.95), "f.hex": ("binary_hex", True, 0.95), "i.csv": ("csv", True, 0.95), "j": ("unified", True, 0.4)} | {"a.json": best["a.json"]}
    assert best["a.json"][0] in ("json_lines", "unified") and best["e.txt"][0] == "syslog" and best["g.bin"] == ("binary_hex", True, 1.0) and best["h"][0] == "unified"
    for f in range(len(FILES)):
        told = sorted(((not r.supported, -r.score) for r in got if r.file_id == str(f)))
        assert told == [(not r.supported, -r.score) for r in sorted((r for r in got if r.file_id == str(f)), key=lambda r: r.rank)]


def test_engine_goes_by_claims(spark):
    files = sources.inline_files(spark, [("x.dat", SYSLOG), ("y.csv", "name,n\na,1\nb,2")])
    best = {r.file_id: r.parser_key for r in detect.discovered(files, lines_of(files)).where("rank = 0").collect()}
    p = engine.parse(files, discover=True)
    assert best["0"] == "syslog" and p.tables["syslog"].count() == 20 and set(p.reports) >= set(best.values())


def test_columns_are_refined_three_times_at_most(spark):
    lines = spark.createDataFrame([(f, k, f"name={k} size: {k}" if k % 2 else "name=x") for f in "ab" for k in range(1, 150)] + [("a", 200, " ")], "file_id string, line_no long, line string")
    asked = []

    def propose(shown, columns, high):
        asked.append(([c.name for c in columns], high))
        assert len(shown) == 50 and shown[0] == "name=1 size: 1"
        return [schema.Column(n, "TEXT") for n in (["name", "size", "w"], ["name", "size", "x"], ["name", "y"], ["name", "z"])[len(asked) - 1]]

    got = schema.refined(lines, propose)
    assert [c.name for c in got.columns] == ["name", "z"] and not got.warnings
    assert got.rates == [{"name": 0.0, "size": 0.5, "w": 1.0}, {"name": 0.0, "size": 0.5, "x": 1.0}, {"name": 0.0, "y": 1.0}, {"name": 0.0, "z": 1.0}]
    assert asked[1:] == [(["name", "size", "w"], {"w": 1.0}), (["name", "size", "x"], {"x": 1.0}), (["name", "y"], {"y": 1.0})]
    calm = schema.refined(lines, lambda shown, columns, high: [schema.Column("name", "TEXT")])
    assert len(calm.rates) == 1
    none = schema.refined(lines, lambda *_: None)
    assert [c.name for c in none.columns] == ["message", "log_level", "source"] and none.warnings


def test_outcomes_are_kept_across_runs_and_expire(spark, tmp_path):
    """Batches of outcomes: sums go on from run to run, thirty days without news are the end, and the limit keeps what was used last."""
    inbox, store, checkpoint = (str(tmp_path / x) for x in ("inbox", "store", "checkpoint"))
    row = lambda k, ok, day, conf=0.9: (k, f"fp-{k}", "web", "default", "syslog", conf, "flat", ok, f"2024-{1 + day // 28:02d}-{1 + day % 28:02d} 00:00:00")
    columns = [x.split(" ") for x in stores.OUTCOMES.split(", ")]

    def run(rows, limit=1000):
        df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if k == 'timestamp' else k}" for c, k in columns))
        df.select(*[F.col(c).cast(k).alias(c) for c, k in columns]).write.mode("append").parquet(inbox)
        stores.keep_available(stores.outcome_stream(spark, inbox), store, checkpoint, limit).awaitTermination(120)
        return {r.schema_key: (r.successes, r.failures, r.access_count, r.format_confidence) for r in stores.current(spark, store).collect()}

    assert stores.current(spark, store).count() == 0
    assert run([row("a", True, 0), row("a", False, 1, 0.95), row("b", True, 1)]) == {"a": (1, 1, 2, 0.95), "b": (1, 0, 1, 0.9)}
    assert run([row("a", True, 20, 0.7), row("c", False, 20), (None, *row("x", True, 20)[1:])]) == {"a": (2, 1, 3, 0.7), "b": (1, 0, 1, 0.9), "c": (0, 1, 1, 0.9)}
    late = run([row("d", True, 45)])
    assert set(late) == {"a", "c", "d"}  # b had no news for 44 days
    assert run([row("b", True, 46)])["b"] in ((1, 0, 1, 0.9), (2, 0, 2, 0.9)) and set(run([row("e", True, 47), row("f", True, 48)], 3)) == {"b", "e", "f"}
    known = stores.current(spark, store)
    assert known.where("schema_key = 'f'").first().fingerprint == "fp-f"


def test_a_run_tells_its_outcomes(spark, tmp_path):
    files = sources.inline_files(spark, [("e.txt", SYSLOG), ("h", "free text\nof no kind")])
    classified = detect.classify(files, lines_of(files))
    engine.learn(classified, str(tmp_path / "inbox"), True, F.lit("2024-05-01"))
    engine.learn(classified, str(tmp_path / "inbox"), False, F.lit("2024-05-02"))
    stores.keep_available(stores.outcome_stream(spark, str(tmp_path / "inbox")), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination(120)
    got = stores.current(spark, str(tmp_path / "store")).collect()
    assert len(got) == 2 and all((r.successes, r.failures, r.access_count) == (1, 1, 2) for r in got)
    again = detect.classify(files, lines_of(files), stores.current(spark, str(tmp_path / "store")))
    assert {r.filename: r.detected_format for r in again.collect()}["e.txt"] == "syslog"
