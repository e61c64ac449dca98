"""The guard, the dialect, exports, the stream."""

import pytest
from pyspark.sql import functions as F

from tracemill.operators import line_parsers, tables
from tracemill.plans import sql
from tracemill.streaming import rates


@pytest.fixture(scope="module")
def allowed(spark):
    spark.createDataFrame([(1, "a", 1.5), (2, "b", None), (3, "b", 2.5)], "id long, kind string, v double").createOrReplaceTempView("things")
    spark.createDataFrame([(1,)], "id long").createOrReplaceTempView("secret")
    return {"things"}


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM things",
        'SELECT "kind", count(*) AS n FROM "things" GROUP BY "kind";',
        "WITH c AS (SELECT id FROM things) SELECT * FROM c",
        "SELECT (SELECT max(id) FROM things) AS m",
        "SELECT CAST(id AS TEXT) AS t, CAST(v AS REAL) AS r FROM things WHERE kind ILIKE 'B'",
        "SELECT 'drop table x' AS s FROM things",
    ],
)
def test_reads(spark, allowed, text):
    assert sql.run(spark, text, allowed).error is None


@pytest.mark.parametrize(
    "text",
    [
        "",
        "DROP TABLE things",
        "INSERT INTO things VALUES (1, 'a', 2)",
        "WITH c AS (SELECT 1 AS id) INSERT INTO things SELECT * FROM c",
        "SELECT 1; SELECT 2",
        "SET a=b",
        "SHOW TABLES",
        "SELECT * FROM secret",
        "SELECT * FROM things WHERE id IN (SELECT id FROM secret)",
        "SELECT * FROM parquet.`/tmp/x`",
        "SELECT * FROM default.things",
        "SELECT reflect('java.lang.System', 'getenv', 'HOME')",
        "CREATE TABLE x AS SELECT 1",
        "DELETE FROM things",
        "not sql",
    ],
)
def test_refuses(spark, allowed, text):
    with pytest.raises(sql.NotAllowed):
        sql.check(spark, text, allowed)
    assert sql.run(spark, text, allowed).error


def test_result_is_capped_but_counted(spark, allowed):
    spark.range(700).createOrReplaceTempView("many")
    r = sql.run(spark, "SELECT * FROM many", {"many"})
    assert len(r.rows) == 500 and r.row_count == 700
    assert sql.run(spark, "SELECT nope FROM things", allowed).error


def test_question_in_words(spark, allowed):
    r = sql.ask(spark, "how many?", allowed, lambda q, schema: f"```sql\n{sql.row_count('things')}\n```" if "kind string" in schema else "")
    assert r.rows == [{"row_count": 3}]
    assert sql.run(spark, sql.value_distribution("things", "kind"), allowed).rows[0] == {"value": "b", "n": 2}
    assert sql.run(spark, sql.casted_averages("things", ["v", "kind"]), allowed).rows == [{"avg_v": 2.0, "avg_kind": None}]
    assert sql.run(spark, sql.time_range("things", "id"), allowed).rows == [{"first": 1, "last": 3}]
    assert len(sql.run(spark, sql.preview_rows("things", 2), allowed).rows) == 2


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, None, [1, 2]), (2, 'q"x', [])], "a long, b string, c array<int>")
    rows = {r.a: (r.b, r.c) for r in tables.export_rows(df).collect()}
    assert rows == {"1": ("", "[1,2]"), "2": ('q"x', "[]")}
    tables.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    tables.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    text = tables.report("R", {"t": df}, spark.createDataFrame([("high",)], "severity string"))
    assert "| a | b | c |" in text and "- high: 1" in text


def test_visible_columns(spark):
    df = spark.createDataFrame([], "id long, raw string, source string, run_id string, name string, gone string")
    assert tables.visible_columns(df, {"gone": 1.0}) == ["name"]


def test_stream_equals_batch(spark, tmp_path):
    lines = [f"2024-01-01 0{h}:{m:02}:00 {'ERROR' if m % 10 == 0 else 'INFO'} x{m}" for h in range(3) for m in range(0, 60, 5)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("\n".join(lines))
    stream = rates.error_rate(rates.timed(rates.line_stream(spark, str(tmp_path / "in"))), "1 hour")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert q.awaitTermination(120)
    batch = rates.error_rate(rates.timed(spark.createDataFrame([(x,) for x in lines], "line string")), "1 hour")
    assert sorted(map(tuple, spark.table("rates").collect())) == sorted(map(tuple, batch.collect()))
    assert {r.n_errors for r in batch.collect()} == {6}


def test_stream_templates(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-01 00:00:00 user 1\n2024-01-01 00:01:00 user 2\n2024-01-01 09:00:00 end\n")
    d = rates.template_counts(rates.timed(rates.line_stream(spark, str(tmp_path / "in"))))
    rates.write_available(d, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [2]
    s = rates.sessions(spark.createDataFrame([("u", "2024-01-01 00:00:00"), ("u", "2024-01-01 00:10:00"), ("u", "2024-01-01 05:00:00")], "u string, t string").select("u", F.to_timestamp("t").alias("at")), "u")
    assert sorted(r.n for r in s.collect()) == [1, 2]


def test_exports_hold_every_row(spark):
    df = spark.range(100_001)
    assert tables.export_rows(df).count() == 100_001 and tables.export_rows(df, 3).count() == 3


def test_printable_strings_are_all_found(spark):
    files = spark.createDataFrame([(1, "a.bin", "word\n" * 600)], "file_id long, filename string, content string")
    assert line_parsers.printable_strings(files).count() == 600 and line_parsers.printable_strings(files, 500).count() == 500


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [(1, 7, 2, 1.5, "a"), (2, -7, 2, None, "b/c"), (3, None, 3, 2.5, None), (4, 9, 4, 0.5, "a")]
    spark.createDataFrame(rows, "id long, a int, b long, v double, s string").createOrReplaceTempView("numbers")
    return {"numbers"}


@pytest.mark.parametrize(
    "text, want",
    [
        ("SELECT a / b AS q FROM numbers WHERE id < 3 ORDER BY id", [3, -3]),
        ("SELECT 7/2 AS q", [3]),
        ("SELECT 7 / 2.0 AS q", [3.5]),
        ("SELECT CAST(7 AS REAL) / 2 AS q", [3.5]),
        ("SELECT (a + 1) / (b) / 2 + 1/2 AS q FROM numbers WHERE id = 1", [2]),
        ("SELECT sum(b) / count(*) AS q FROM numbers", [2]),
        ("SELECT v / b AS q FROM numbers WHERE id = 1", [0.75]),
        ("SELECT '7/2' || s AS q FROM numbers WHERE s = 'b/c' -- 1/2", ["7/2b/c"]),
        ("SELECT q FROM (SELECT a /* a/b */ / b AS q FROM numbers WHERE id = (SELECT 9 / 9 FROM numbers WHERE id = 1))", [3]),
        ("WITH c AS (SELECT b / 2 AS h, id FROM numbers) SELECT h / 2 AS q FROM c ORDER BY id", [0, 0, 0, 1]),
        ("SELECT avg(a) / 2 AS q FROM numbers WHERE id = 1", [3.5]),
        ("SELECT a FROM numbers ORDER BY a", [-7, 7, 9, None]),
        ("SELECT a FROM numbers ORDER BY a DESC", [None, 9, 7, -7]),
        ("SELECT a FROM numbers ORDER BY a ASC NULLS FIRST", [None, -7, 7, 9]),
        ("SELECT id FROM numbers ORDER BY s DESC, a / b, id LIMIT 3", [3, 2, 4]),
        ("SELECT first_value(id) OVER (ORDER BY a) AS q FROM numbers", [2, 2, 2, 2]),
        ("SELECT DISTINCT ON (s) id FROM numbers ORDER BY s, id DESC", [4, 2, 3]),
        ("SELECT DISTINCT ON (s) s, v FROM numbers ORDER BY s DESC, v DESC LIMIT 2", [None, "b/c"]),
        ("SELECT count(*) AS n FROM (SELECT DISTINCT ON (b / 2, lower(s)) id, s FROM numbers) t", [4]),
        ("SELECT DISTINCT ON (a) id FROM numbers WHERE a > 0 UNION ALL SELECT id FROM numbers WHERE id = 3", None),
    ],
)
def test_dialect(spark, numbers, text, want):
    r = sql.run(spark, text, numbers)
    assert r.error is None, r.error
    got = [list(x.values())[0] for x in r.rows]
    assert sorted(got) == [1, 3, 4] if want is None else got == want
    assert not any(c.startswith("__") for c in r.columns)
