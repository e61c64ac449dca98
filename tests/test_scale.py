"""What is done in two steps or by neighbours gives what a plain pass over everything gives."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracemill.functions import patterns as P
from tracemill.operators import cache, detect, line_parsers, structured, templates

TEXTS = ("", "  ", "2024-01-01 00:00:00 ERROR boom", "    at a.b(C.java:1)", "Caused by: x", "--- part one ---", "k = 1", "plain", "00000000  41 42 43 44")


@pytest.fixture(scope="module")
def told():
    r = random.Random(5)
    return [(f, f"{f}.log", n, r.choice(TEXTS)) for f in "abc" for n in sorted(r.sample(range(1, 60), 40))]


@pytest.fixture(scope="module")
def lines(spark, told):
    return spark.createDataFrame(told, "file_id string, filename string, line_no long, line string").repartition(3)


@pytest.fixture(params=[1, 3, 4096])
def parts(request, monkeypatch):
    monkeypatch.setattr(line_parsers, "PART_LINES", request.param)


def _by_file(told):
    return {f: [(n, x) for g, _, n, x in told if g == f] for f in "abc"}


def test_blocks_in_parts(lines, told, parts):
    want = set()
    for f, rows in _by_file(told).items():
        begun, blank = [], None
        for n, x in rows:
            if x.strip():
                if not (begun and blank is False and re.match(P.CONTINUATION, x)):
                    begun.append([])
                begun[-1].append((n, x))
            blank = not x.strip()
        want |= {(f, b[0][0], b[-1][0], len(b), "\n".join(x for _, x in b)) for b in begun}
    assert {(r.file_id, r.start_line, r.end_line, r.n_lines, r.raw) for r in line_parsers.blocks(lines).collect()} == want


def test_boundaries_in_parts(lines, told, parts):
    want, stamp = set(), "^" + P.ISO_TIMESTAMP
    for f, rows in _by_file(told).items():
        for (_, before), (n, x) in zip([(0, "")] + rows, rows):
            header = bool(re.match(P.SECTION_HEADER, x.strip()))
            if n > 1 and (header or (re.match(stamp, x.strip()) and before.strip(" ") and not re.match(stamp, before.strip()))):
                want.add((f, n, "section" if header else "timestamp"))
    assert {(r.file_id, r.line_no, r.reason) for r in line_parsers.boundaries(lines).collect()} == want


def test_sections_and_offsets_in_parts(lines, told, parts):
    named, offsets = set(), set()
    for f, rows in _by_file(told).items():
        section, at = "general", 0
        for n, x in rows:
            if x.startswith("---"):
                section = "part_one"
            elif x == "k = 1":
                named.add((f, n, section))
            elif x.startswith("0000"):
                offsets.add((f, n, at))
                at += 4
    assert {(r.file_id, r.line_no, r.section) for r in line_parsers.sections(lines).where("key = 'k'").collect()} == named
    assert {(r.file_id, r.line_no, r.offset) for r in line_parsers.hex_dump(lines).collect()} == offsets


@pytest.mark.parametrize("threshold", [0.85, 0.7, 0.3])
def test_similar_formats_by_neighbours(spark, threshold):
    r = random.Random(1)
    rows = [(f"{r.randrange(120):04d}", r.choice(["csv", "syslog"]), r.choice(["structured", "unstructured"]), r.random() < 0.5, r.random() < 0.5, round(r.uniform(1, 9), 1)) for _ in range(160)]
    prints = spark.createDataFrame(rows, "fingerprint string, format_name string, structural_class string, has_timestamps boolean, has_log_levels boolean, avg_line_length double")
    known, want = {}, {}
    for p, *x in rows:
        known[p] = min(known.get(p, x), x)
    for p, *x in rows:
        for q, y in known.items():
            score = sum(w for w, a, b in zip((0.4, 0.2, 0.1, 0.1), x, y) if a == b) + 0.2 * min(x[4], y[4]) / max(x[4], y[4], 1)
            if q != p and score >= threshold:
                want[p] = max(want.get(p, (0, "")), (round(score, 12), q))
    got = {(x.fingerprint, x.similar, x.score) for x in detect.similar_formats(prints, prints, threshold).collect()}
    assert got == {(p, q, round(s, 6)) for p, (s, q) in want.items()}


def test_last_of_equal_keys(spark):
    d = spark.createDataFrame([("a=1 b=2 a=3 c=4 b=5",), ("a=1",), ("none",), ("A=1 a=2",)], "line string")
    assert [dict(r.m) for r in d.select(line_parsers.pairs(F.col("line"), P.LOGFMT_PAIR).alias("m")).collect()] == [{"a": "3", "c": "4", "b": "5"}, {"a": "1"}, {}, {"a": "2"}]


def test_evictions_and_few_shots(spark):
    t = spark.createDataFrame([(f"{k:02d}", k % 5, k) for k in range(20)], "template_id string, count int, last_seen int")
    assert templates.evict(t, 30).count() == 20
    assert {r.template_id for r in t.exceptAll(templates.evict(t, 20)).collect()} == {"00", "05"}
    store = spark.sql("select concat('k', id) as schema_key, timestamp'2024-01-31' - make_interval(0, 0, 0, cast(id as int) * 20) as updated_at from range(5)")
    kept = cache.evict(store, F.lit("2024-01-31").cast("timestamp"), 2).collect()
    assert sorted(r.schema_key for r in kept) == ["k0", "k1"]
    shots = spark.createDataFrame([("s1", "csv", "fab", 0.9, 3), ("s2", "csv", "unknown", 0.8, 5), ("s3", "csv", "web", 0.9, 9), ("s4", "xml", "fab", 0.7, 3)], "signature string, format string, domain string, confidence double, usage int")
    assert [r.signature for r in cache.few_shots(shots, "fab").collect()] == ["s2", "s1", "s4"]


def _packed(n, cuts, target, most):
    """One step after another."""
    edges = [1, *cuts, n + 1] if cuts else [*range(1, n + 1, target), n + 1]
    out, at = [], 0
    while at < len(edges) - 1:
        a, b = edges[at], edges[at + 1]
        if b - a > most:
            out += [(k, min(k + target, b) - 1) for k in range(a, b, target)]
            at += 1
            continue
        to = at + 1
        while to < len(edges) - 1 and edges[to + 1] - a <= target:
            to += 1
        out.append((a, edges[to] - 1))
        at = to
    return out


def test_packed_chunks_by_doubling(spark, parts):
    r = random.Random(7)
    files = {"short": (40, []), "even": (230, []), "edge": (50, [26]), "huge": (900, [100]), "many": (600, sorted(r.sample(range(2, 600), 150))), "few": (700, sorted(r.sample(range(2, 700), 8)))}
    told = [(f, f, k, "--- part ---" if k in cuts else "x") for f, (n, cuts) in files.items() for k in range(1, n + 1)]
    lines = spark.createDataFrame(told, "file_id string, filename string, line_no long, line string").repartition(4)
    got: dict = {}
    for x in sorted(line_parsers.packed_chunks(lines, 50, 200).collect(), key=lambda x: (x.file_id, x.chunk)):
        assert x.chunk == len(got.setdefault(x.file_id, []))
        got[x.file_id].append((x.start_line, x.end_line))
    assert got == {f: _packed(n, cuts, 50, 200) for f, (n, cuts) in files.items()}


def test_units_of_endless_blocks_are_bounded(spark, parts):
    lines = spark.range(3000).selectExpr("if(id < 2500, 'yaml', 'one') as file_id", "'f' as filename", "id + 1 as line_no", "if(id in (0, 2500), 'head', concat('    indented ', id, repeat('.', 40))) as line")
    whole = {r.file_id: r for r in line_parsers.blocks(lines).collect()}
    cut = {r.file_id: r for r in line_parsers.blocks(lines, 1000).collect()}
    one = {r.file_id: r for r in line_parsers.file_units(lines, 1000).collect()}
    for f, r in whole.items():
        assert cut[f].raw == r.raw[:1000] == one[f].raw and len(r.raw) > 1000
        assert (cut[f].start_line, cut[f].end_line, cut[f].n_lines) == (r.start_line, r.end_line, r.n_lines) and one[f].end_line == r.end_line


def test_delimited_rows_are_numbered_in_parts(spark, parts):
    told = [(f, f"{f}.csv", k, "name,n" if k == 2 else "" if k % 7 == 1 else f"row {k},{k}") for f in "ab" for k in range(1, 60)]
    got = structured.delimited(spark.createDataFrame(told, "file_id string, filename string, line_no long, line string").repartition(5)).collect()
    want = {(f, k, str(n)) for f in "ab" for k, n in enumerate((n for n in range(3, 60) if n % 7 != 1), 1)}
    assert {(r.file_id, r.row_no, r.fields["n"]) for r in got} == want
