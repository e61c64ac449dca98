"""Parsers, detection and the engine on small files."""

import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from tracemill.functions import scalars as S
from tracemill.operators import anomaly, detect, line_parsers, quality, schema, structured, templates
from tracemill.plans import engine
from tracemill.plans.catalog import Catalog
from tracemill.sources import files as sources
from tracemill.sources.lines import lines_of, read_lines

CSV = "Tool ID,Chamber,Temp\nT1,A,20.5\nT1,B,21.0\nT2,A,19.25\n"
XML = """<?xml version="1.0"?>
<events site="x"><event id="1"><level>INFO</level><message>one</message></event>
<event id="2"><level>WARNING</level><message>two</message></event></events>"""
RECIPE = """<recipe name="R" version="2" tool="T" chamber="C" author="a"><metadata created_ts="2024-01-01T00:00:00Z"/>
<step seq="1" name="s1" duration_s="5"><setpoint name="p" value="7.5"/><interlock name="i" required="true"/></step>
<step seq="2" name="s2" duration_s="6"><tolerance name="t" low="1" high="2"/></step></recipe>"""
JSON = '{"run_id": "r1", "tool": "t", "chambers": ["A", "B"], "result": {"status": "pass", "film": 1.5}, "steps": [{"seq": 1, "name": "x"}, {"seq": 2, "set": {"p": 3}}], "meta": {"a": {"b": true}}}'
NDJSON = '{"ts": "2024-01-01", "a": {"b": 1}}\nnot json\n{"ts": "2024-01-02", "tags": ["x", "y"]}\n[1]\n'
SYSLOG = "<34>Oct 11 22:14:15 host1 su[12]: fatal failure\n<13>Oct 11 22:14:16 host1 cron: ok\nbroken\nOct 12 00:00:00 h2 app: warn here\n"
ACCESS = '1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /a HTTP/1.0" 500 12 "-" "curl"\n1.2.3.4 - - [10/Oct/2000:13:55:37 -0700] "GET /b HTTP/1.0" 404 7\n'
LOGFMT = 'ts=1 level=info msg="a b" k=1\nts=2 level=error k=2 k=3\nnothing here\n'
JAVA = "2024-01-01 00:00:00 ERROR boom\n    at a.b(C.java:1)\nCaused by: x\n    ... 3 more\n\n2024-01-01 00:00:01 INFO fine\n"
HEX = "00000000  48 65 6c 6c 6f 00\nnot a dump line at all\n00000006  41 42 43 44  |ABCD|\n"


@pytest.fixture(scope="module")
def files(spark):
    return sources.inline_files(spark, [("a.csv", CSV), ("b.xml", XML), ("r.xml", RECIPE), ("c.json", JSON), ("d.ndjson", NDJSON), ("e.log", SYSLOG), ("f.log", ACCESS), ("g.txt", LOGFMT), ("h.log", JAVA), ("i.hex", HEX), ("empty.txt", "")])


def one(files, name):
    return files.where(F.col("filename") == name)


def test_lines_split_like_text_lines(spark):
    f = sources.inline_files(spark, [("x", "a\r\nb\n\nc\x0bd\n"), ("y", ""), ("z", "one")])
    got = {(r.filename, r.line_no): r.line for r in lines_of(f).collect()}
    assert got == {("x", 1): "a", ("x", 2): "b", ("x", 3): "", ("x", 4): "c", ("x", 5): "d", ("z", 1): "one"}


def test_classification(spark, files):
    got = {r.filename: (r.detected_format, r.parser_key) for r in detect.classify(files, lines_of(files)).collect()}
    assert got["a.csv"] == ("csv", "csv")
    assert got["b.xml"][1] == got["r.xml"][1] == "xml"
    assert got["c.json"][1] == got["d.ndjson"][1] == "json_lines"
    assert got["e.log"] == ("syslog", "syslog")
    assert got["f.log"][0] == "apache_access"
    assert got["g.txt"][0] == "logfmt"
    assert got["i.hex"][1] == "binary_hex"
    assert got["empty.txt"][0] == "unknown"
    verdict = detect.overall(detect.classify(files, lines_of(files))).first()
    assert 0 < verdict.confidence <= 1 and verdict.n_files == 10


def test_known_fingerprint_goes_first(spark, files):
    lines = lines_of(files)
    known = detect.fingerprints(lines).where("format_name = 'logfmt'").select("fingerprint", F.lit("key_value").alias("detected_format"), F.lit(0.9).alias("format_confidence"))
    got = {r.filename: r.detected_format for r in detect.classify(files, lines, known).collect()}
    assert got["g.txt"] == "key_value" and got["e.log"] == "syslog"


def test_syslog(files):
    rows = line_parsers.syslog(lines_of(one(files, "e.log"))).orderBy("line_no").collect()
    assert [(r.host, r.process, r.pid, r.log_level, r.syslog_facility, r.syslog_severity) for r in rows] == [("host1", "su", 12, "FATAL", 4, 2), ("host1", "cron", None, "INFO", 1, 5), ("h2", "app", None, "WARNING", None, None)]
    assert [r.warning for r in line_parsers.rejected(lines_of(one(files, "e.log")), "syslog").collect()] == ["line 3: not valid syslog format"]


def test_access_and_logfmt(files):
    a = line_parsers.access(lines_of(one(files, "f.log"))).orderBy("line_no").collect()
    assert [(r.status, r.body_bytes, r.user_agent, r.log_level) for r in a] == [(500, "12", "curl", "ERROR"), (404, "7", None, "WARNING")]
    k = line_parsers.logfmt(lines_of(one(files, "g.txt"))).orderBy("line_no").collect()
    assert [r.fields for r in k] == [{"ts": "1", "level": "info", "msg": "a b", "k": "1"}, {"ts": "2", "level": "error", "k": "3"}]


def test_blocks_and_hex(files):
    b = line_parsers.blocks(lines_of(one(files, "h.log"))).orderBy("start_line").collect()
    assert [(r.start_line, r.end_line, r.n_lines) for r in b] == [(1, 4, 4), (6, 6, 1)]
    h = line_parsers.hex_dump(lines_of(one(files, "i.hex"))).orderBy("offset").collect()
    assert [(r.offset, r.hex_bytes, r.ascii_repr) for r in h] == [(0, "48656c6c6f00", "Hello."), (6, "41424344", "ABCD")]


def test_json(files):
    rows = structured.json_documents(one(files, "c.json")).collect()
    run = next(r.fields for r in rows if r.logical_name == "run")
    assert run["document_id"] == "r1" and run["chamber_count"] == "2" and run["chambers"] == "A,B" and run["result_status"] == "pass" and run["meta_a_b"] == "true" and run["step_count"] == "2"
    assert [r.fields for r in rows if r.logical_name == "steps"] == [{"document_id": "r1", "item_index": "1", "seq": "1", "name": "x", "run_id": "r1"}, {"document_id": "r1", "item_index": "2", "seq": "2", "set_p": "3", "run_id": "r1"}]
    lines = lines_of(one(files, "d.ndjson"))
    assert [r.fields for r in structured.json_lines(lines).orderBy("row_no").collect()] == [{"source_file": "d.ndjson", "ts": "2024-01-01", "a_b": "1"}, {"source_file": "d.ndjson", "ts": "2024-01-02", "tags": "x,y"}]
    assert [r.warning for r in structured.invalid_json(lines).orderBy("line_no").collect()] == ["line 2: invalid JSON object", "line 4: JSON value is not an object"]


def test_xml(files):
    rows = structured.xml_documents(one(files, "b.xml")).collect()
    assert [r.logical_name for r in rows] == ["events", "event", "event"]
    assert rows[1].fields["id"] == "1" and rows[2].fields["message"] == "two" and rows[0].fields["site"] == "x"
    tables = [r.logical_name for r in structured.xml_documents(one(files, "r.xml")).collect()]
    assert tables == ["recipe", "recipe_steps", "recipe_setpoints", "recipe_interlocks", "recipe_steps", "recipe_tolerances"]
    assert structured.xml_document("x", "<a><b></a>") == []
    leaves = structured.xml_document("x", "<a><b>1</b><b>2</b></a>")
    assert [f.get("value") for n, f in leaves if n == "b"] == ["1", "2"]


def test_delimited(spark):
    f = sources.inline_files(spark, [("p.tsv", 'A\tA\tB\n1\t"x\ty"\t5\n2\tz\tw\tmore\n3\tq\n'), ("n.csv", "1,2\n3,4\n")])
    rows = {(r.filename, r.row_no): r.fields for r in structured.delimited(lines_of(f)).collect()}
    assert rows[("p.tsv", 1)] == {"source_file": "p.tsv", "a": "1", "a_2": "x\ty", "b": "5"}
    assert rows[("p.tsv", 2)]["b"] == "w" and rows[("p.tsv", 3)]["b"] == ""
    assert rows[("n.csv", 1)] == {"source_file": "n.csv", "column_1": "1", "column_2": "2"}


def test_schema_and_types(spark):
    r = spark.createDataFrame([("t", {"a": "1", "b": "x", "c": "true"}), ("t", {"a": "2.5", "b": "null", "c": "7"})], "logical_name string, fields map<string,string>")
    cols = schema.columns_of(schema.infer(r))["t"]
    assert [(c.name, c.sql_type, c.nullable) for c in cols] == [("a", "REAL", False), ("b", "TEXT", True), ("c", "INTEGER", False)]
    t = schema.typed(schema.normalized(r), cols)
    assert dict(t.dtypes) == {"a": "double", "b": "string", "c": "bigint"}
    assert "`a` DOUBLE NOT NULL" in schema.ddl("t", cols)


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [("007", "integer", "7"), ("42)", "integer", "42"), ("-1.50", "real", "-1.50"), ("2.34e14", "text", "2.34e14"), ("WARNING", "text", "WARN"), ("n/a", "null", None), ("", "text", ""), ("True", "boolean", "true"), ("2024-01-02 03:04:05Z", "text", "2024-01-02T03:04:05+00:00"), ("2024-01-02T03:04:05.5+08:00", "text", "2024-01-02T03:04:05.500000+08:00"), (None, "null", None), (" a ", "text", "a")],
)
def test_coerce(spark, text, kind, value):
    r = spark.createDataFrame([(text,)], "t string").select(S.coerce(F.col("t")).alias("c")).first().c
    assert (r.kind, r.value) == (kind, value)


def test_identifiers(spark):
    cases = {"pressure_mTorr": "pressure_mtorr", " a--b ": "a_b", "": "field", "10:30": "field_10_30", "Straße": "straße"}
    got = {r.t: r.n for r in spark.createDataFrame([(k,) for k in cases], "t string").select("t", S.sanitize_identifier(F.col("t")).alias("n")).collect()}
    assert got == cases
    long = spark.createDataFrame([("x" * 80,)], "t string").select(S.sanitize_identifier(F.col("t")).alias("n")).first().n
    assert len(long) == 63 and long[54] == "_"
    assert S.unique_names(["a", "b", "a", "a"]) == ["a", "b", "a_2", "a_3"]


def test_skeleton(spark):
    got = spark.createDataFrame([("  u 10.0.0.1  id 550e8400-e29b-41d4-a716-446655440000 h deadbeef99 'q' 3.5 ",)], "t string").select(S.skeleton(F.col("t")).alias("s")).first().s
    assert got == 'u <IP> id <UUID> h <HEX> "<STR>" <NUM>'


def test_templates_evolve(spark):
    rows = [(f"f{k}", k, f"the quick brown fox jumps over the lazy dog near the river bank in the dark of {'night' if k % 3 else 'winter'} all alone again and again number {k}") for k in range(30)]
    t = templates.mine(spark.createDataFrame(rows, "file_id string, line_no long, line string"))
    assert sorted(r["count"] for r in t.collect()) == [10, 20]
    e = templates.evolve(t, 0.85).collect()
    assert [(r["count"], r.n_merged) for r in e] == [(30, 2)]


def test_gate(spark):
    t = spark.createDataFrame([("a", None, "x", "x"), ("b", None, "y", "y")], "k string, v string, raw string, message string")
    g = quality.evaluate("t", t, ["k", "v"])
    assert g.failed and len(g.warnings) == 2 and g.table_null_ratio == 0.5
    head = quality.evaluate("t", spark.createDataFrame([("k", "v")], "k string, v string"), ["k", "v"])
    assert "header" in head.warnings[0]
    assert not quality.evaluate("t", spark.createDataFrame([("1", "2")], "k string, v string"), ["k", "v"]).failed
    assert quality.evaluate("e", t.limit(0), ["k"]).table_null_ratio == 1.0


def test_anomalies(spark):
    rows = [("f", k, k, "error: <script>" if k < 4 else "fine", {"log_level": "INFO", "x": None}, 0.3 if k < 4 else 0.9) for k in range(10)]
    u = spark.createDataFrame(rows, "file_id string, start_line long, end_line long, raw string, fields map<string,string>, confidence double")
    got = anomaly.summary(anomaly.report(u)).first().asDict()
    assert got == {"critical": 4, "high": 2, "medium": 1, "low": 0}


def test_archives(spark):
    z, t = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.log", "one")
        f.writestr("d/b.log", "two")
    with tarfile.open(fileobj=t, mode="w") as f:
        info = tarfile.TarInfo("c.log")
        info.size = 5
        f.addfile(info, io.BytesIO(b"three"))
    rows = [("1", "x.zip", z.getvalue()), ("2", "y.log.gz", gzip.compress(b"four")), ("3", "z.tar", t.getvalue()), ("4", "p.txt", "fünf".encode()), ("5", "l.txt", b"f\xfcnf"), ("6", "bad.zip", b"PK\x03\x04broken")]
    d = sources.decode_bytes(sources.expand_archives(spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "file_id string, filename string, bytes binary")))
    got = {r.filename: r.content for r in d.collect()}
    assert got["x.zip:a.log"] == "one" and got["x.zip:d/b.log"] == "two" and got["y.log"] == "four" and got["z.tar:c.log"] == "three" and got["p.txt"] == got["l.txt"] == "fünf" and "bad.zip" in got


def test_engine_end_to_end(spark, files):
    p = engine.parse(files)
    assert p.parser_key == "mixed" and 0 < p.confidence < 1
    assert {"run", "steps", "event", "recipe", "recipe_setpoints", "syslog", "access", "logfmt"} <= set(p.tables)
    assert p.tables["recipe_setpoints"].first().setpoint_value == 7.5
    assert p.tables["syslog"].count() == 3
    joined = schema.join_child({"recipe_steps": p.tables["recipe_steps"], "recipe_setpoints": p.tables["recipe_setpoints"]}, schema.RECIPE_RELATIONSHIPS[1])
    assert joined.count() == 1
    c = Catalog(spark, "parsed_files")
    names = engine.persist(p, c)
    assert set(names) <= set(c.tables()) and c.registry().count() == len(c.tables())
    from tracemill.plans import sql

    r = sql.run(spark, 'SELECT log_level, count(*) AS n FROM "syslog" GROUP BY log_level ORDER BY 1', c.expose())
    assert r.error is None and [x["log_level"] for x in r.rows] == ["FATAL", "INFO", "WARNING"]
    facts = engine.insights(spark, lines_of(files))
    assert facts["severity"] in anomaly.SEVERITIES + ("none",)


def test_read_lines_of_a_folder(spark, tmp_path):
    (tmp_path / "a.log").write_text("x\ny\n")
    got = [(r.filename, r.line) for r in read_lines(spark, str(tmp_path)).orderBy("line_no").collect()]
    assert got == [("a.log", "x"), ("a.log", "y")]


def test_catalog_changes(spark):
    c = Catalog(spark, "changes")
    c.create("t", spark.createDataFrame([(1, "a\x00"), (2, "b")], "k long, s string"))
    assert c.append("t", spark.createDataFrame([(3, "c", 9)], "k long, s string, extra long")) == 3
    first = c.table("t").orderBy("k").first()
    assert first.s == "a"
    c.update("t", first.id, {"s": "z"})
    assert c.get("t", first.id).first().s == "z"
    c.delete("t", first.id)
    c.add_column("t", schema.Column("more", "INTEGER"))
    assert "more" in c.table("t").columns and c.table("t").count() == 2
    c.remove_column("t", "more")
    assert "more" not in c.table("t").columns
    c.drop("t")
    assert "t" not in c.tables()


def test_binary_text(spark):
    import base64
    import zlib

    from tracemill.sources import binary

    noise = bytes(range(256)) * 20
    rows = [("1", "z.bin", noise + b"\x00" + zlib.compress(b"inflated text here")), ("2", "t.bin", b"plain text " * 50), ("3", "b.bin", noise + b"\nBEGIN_B64\n" + base64.b64encode(b"framed text") + b"\nEND_B64\n"), ("4", "e.bin", b"")]
    d = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in rows], "file_id string, filename string, bytes binary")
    got = {r.file_id: r.content for r in binary.decode(d).collect()}
    assert got["1"].startswith("inflated text here") and got["2"] == "plain text " * 50 and got["3"].startswith("framed text\n") and got["4"] == ""
    texts = spark.createDataFrame([("1", "aabb"), ("2", ""), ("3", "a" * 50), ("4", None)], "file_id string, content string")
    assert {r.file_id: r.entropy for r in binary.character_entropy(texts).collect()} == {"1": 1.0, "2": 0.0, "3": 0.0, "4": 0.0}
    g = spark.createDataFrame([("00 41 |a=1|\n00 |b|",), ("x |y|",)], "t string").select(binary.gutter_text(F.col("t")).alias("g")).collect()
    assert [r.g for r in g] == ["a=1\nb", None]


def test_units_and_asking(spark, files):
    lines = lines_of(files)
    assert line_parsers.units(lines_of(one(files, "h.log")), "plain_text").count() == 2
    assert line_parsers.units(lines_of(one(files, "h.log")), "syslog").count() == 5
    mixed = lines_of(one(files, "h.log")).select(F.lit("a").alias("file_id"), "filename", "line_no", "line").unionByName(lines_of(one(files, "h.log")).select(F.lit("b").alias("file_id"), "filename", "line_no", "line"))
    by = line_parsers.units(mixed, files.sparkSession.createDataFrame([("a", "syslog"), ("b", "plain_text")], "file_id string, format string"))
    assert {r.file_id: r["count"] for r in by.groupBy("file_id").count().collect()} == {"a": 5, "b": 2}
    assert line_parsers.file_units(lines).where("file_id = '8'").first().end_line == 6
    u = structured.with_xml_fields(line_parsers.extract_fields(line_parsers.file_units(lines_of(one(files, "b.xml"))))).first()
    assert u.confidence in (0.8, 0.9)
    rows = line_parsers.to_rows(line_parsers.cover(line_parsers.extract_fields(line_parsers.line_units(lines_of(one(files, "g.txt"))))), ["message", "log_level", "k"]).collect()
    assert {r.k for r in rows} == {"1", "3", None} and any(r.extra for r in rows)
    c = detect.classify(files, lines)
    asked = {r.filename: r.detected_format for r in detect.reclassify(c, lines, lambda name, head: "syslog" if "boom" in head else "nonsense").collect()}
    assert asked["h.log"] == "syslog" and asked["e.log"] == "syslog" and asked["g.txt"] == "logfmt"
    claims = detect.parser_support(lines).where("rank = 0").collect()
    assert {r.file_id: r.parser_key for r in claims}["5"] == "syslog"


def test_budget_and_profiles():
    from tracemill.plans import hooks, profiles

    b = hooks.Budget(limit_usd=1.0)
    answers = iter(["nonsense", '{"a": 1}'])
    assert hooks.ask_json(lambda p: next(answers), "question" * 10, b) == {"a": 1} and b.input_tokens > 20
    assert hooks.ask_json(lambda p: "{}", "x" * 100, hooks.Budget(limit_usd=0.0)) is None
    profiles.register_profile(profiles.Profile("etch", "fab", expected_types={"tool_id": "TEXT"}))
    assert profiles.get_profile("etch").missing(["x"]) == ["tool_id"] and profiles.get_profile("nope").name == "default"


def test_delimited_without_header_is_as_wide_as_its_widest_line(spark):
    f = sources.inline_files(spark, [("n.csv", "1,2\n" * 12 + "3,4,5,6\n")])
    rows = sorted(structured.delimited(lines_of(f)).collect(), key=lambda r: r.row_no)
    assert [rows[12].fields[f"column_{k}"] for k in (1, 2, 3, 4)] == ["3", "4", "5", "6"]
    assert len(rows) == 13 and rows[0].fields["column_4"] == ""


def test_unified_reads_each_file_by_its_format(spark):
    """Elements become fields, blocks stay together, lines of line formats are records of their own, brackets go."""
    rows = [("x", "odd.xml", "<event><id>7</id><kind>open</kind></event>\nnot an element\n<event><id>8</id><kind>shut</kind></event>"), ("b", "trace.txt", "something failed\n    at the first frame\n    at the second\nnext one")]
    files = spark.createDataFrame(rows, "file_id string, filename string, content string")
    got = {}
    for r in engine._unified(files, lines_of(files)).collect():
        got.setdefault(r.file_id, []).append(r)
    assert {r.fields.get("id") for r in got["x"]} >= {"7", "8"} and {r.fields["kind"] for r in got["x"] if "kind" in r.fields} == {"open", "shut"}
    assert len(got["b"]) == 2 and "second" in min(got["b"], key=lambda r: r.row_no).fields["raw"]
    assert all({"message", "log_level", "source", "parse_confidence"} <= set(r.fields) for x in got.values() for r in x)


def test_unified_units_of_json_and_commas(spark):
    """One object is one unit, a list gives its objects, other files their lines; rows go under the header."""
    rows = [
        ("o", "one.json", '{"a": {"b": 1},\n "c": [1, 2]}'),
        ("l", "list.json", '[{"a": 1}, 7, {"a": 2}]'),
        ("n", "lines.json", '{"a": {"b": 1}}\nno object\n{"a": 2}'),
        ("c", "t.csv", 'Tool ID,x,x\nT1,"1,5",2\n\nT2,3\nT3,4,5,6'),
        ("h", "only.csv", "just a header"),
        ("w", "words.json", "nothing here"),
    ]
    files = spark.createDataFrame(rows, "file_id string, filename string, content string")
    got = {}
    for r in engine._unified(files, lines_of(files)).collect():
        own = {k: v for k, v in r.fields.items() if k not in ("source", "raw", "message", "log_level", "timestamp")}
        got.setdefault(r.file_id, {})[r.row_no] = own
    assert got["o"] == {1: {"a_b": "1", "c": "1,2", "parse_confidence": "0.98"}}
    assert got["l"] == {1: {"a": "1", "parse_confidence": "0.97"}, 3: {"a": "2", "parse_confidence": "0.97"}}
    assert got["n"] == {1: {"a_b": "1", "parse_confidence": "0.95"}, 3: {"a": "2", "parse_confidence": "0.95"}}
    assert got["c"] == {2: {"tool_id": "T1", "x": "2", "parse_confidence": "0.95"}, 4: {"tool_id": "T2", "x": "3", "parse_confidence": "0.95"}, 5: {"tool_id": "T3", "x": "5", "parse_confidence": "0.95"}}
    assert not {"h", "w"} & set(got)  # plain words in a structured file are noise


def test_readable_decodes_binary_files(spark):
    import zlib

    raw = [("t", "a.log", "plain text, ünd more".encode()), ("z", "a.bin", zlib.compress(b"level=error code=7 " * 30)), ("n", "noise.log", bytes(range(256)) * 4 + b"visible=1")]
    got = {r.file_id: r.content for r in engine.readable(spark.createDataFrame(raw, "file_id string, filename string, bytes binary")).collect()}
    assert got["t"] == "plain text, ünd more" and got["z"].startswith("level=error code=7") and "visible=1" in got["n"] and len(got) == 3


def test_evolve_follows_long_chains(spark):
    """Thirty templates, each similar to the next only, are one group."""
    words = [f"w{k}" for k in range(60)]
    rows = [(f"t{k:02d}", " ".join(words[k : k + 30]), 1 + (k == 17), k, k, ["x"]) for k in range(30)]
    t = spark.createDataFrame(rows, "template_id string, skeleton string, count long, first_seen long, last_seen long, examples array<string>")
    (r,) = templates.evolve(t, 0.9).collect()
    assert (r.template_id, r["count"], r.n_merged, r.first_seen, r.last_seen) == ("t17", 31, 30, 0, 29)


def test_header_check_takes_the_first_row(spark):
    t = spark.createDataFrame([("f", 2, "a", "b"), ("f", 1, "x", "y"), ("f", 3, "1", "2")], "file_id string, row_no long, x string, y string").repartition(3)
    assert "Detected header row emitted as data." in quality.evaluate("t", t, ["x", "y"]).warnings
    assert "Detected header row emitted as data." not in quality.evaluate("t", t.where("row_no > 1"), ["x", "y"]).warnings
