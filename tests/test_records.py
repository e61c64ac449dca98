"""Files read from splits, and archives read as streams, give what a whole read gives."""

import gzip
import io
import json
import random
import tarfile
import zipfile

import pytest

from tracemill.sources import archives, records
from tracemill.sources import files as sources
from tracemill.sources.lines import lines_of


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _item(r, k):
    odd = ['say "}" and \\', "[{", "}}]", "a\nb", "", "\u00e9\u4e2d", '\\"', "x" * r.randrange(90)]
    return {"id": k, "note": r.choice(odd), "nested": {"deep": {"tags": [r.choice(odd), "y"]}, "list": [{"a": 1}, {"b": r.choice(odd)}]}, r.choice(odd) or "k": None}


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("parts", [3, 4096])
def test_json_lists_from_splits(spark, tmp_path, small_splits, monkeypatch, indent, parts):
    monkeypatch.setattr(records, "PART_PIECES", parts)
    r = random.Random(3)
    want = {}
    for name in ("a.json", "b.json"):
        want[name] = [_item(r, k) for k in range(120)]
        (tmp_path / name).write_text(json.dumps(want[name], indent=indent, ensure_ascii=name == "a.json"))
    df = records.json_items(spark, str(tmp_path))
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    got: dict = {}
    for x in sorted(df.collect(), key=lambda x: (x.filename, x.row_no)):
        got.setdefault(x.filename, []).append(json.loads(x["item"]))
        assert x.row_no == len(got[x.filename])
    assert got == want


def test_json_lists_of_other_things(spark, tmp_path, small_splits):
    (tmp_path / "mixed.json").write_text('  [1, "}", [2, {"in": "a list"}], {"a": 1} , null, {"b": {"c": "]"}}, [[{}]], true, {"d": 3}, "x"]\n')
    (tmp_path / "after.json").write_text('{"a": 1}\n{"b": {"c": [2]}} {"d": "}"}\n')
    (tmp_path / "empty.json").write_text("[]")
    (tmp_path / "none.json").write_text("")
    got = {(x.filename, json.dumps(json.loads(x["item"]))) for x in records.json_items(spark, str(tmp_path)).collect()}
    assert got == {("mixed.json", '{"a": 1}'), ("mixed.json", '{"b": {"c": "]"}}'), ("mixed.json", '{"d": 3}'), ("after.json", '{"a": 1}'), ("after.json", '{"b": {"c": [2]}}'), ("after.json", '{"d": "}"}')}


def test_json_records_have_fields(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"Name One": "x", "in": {"a": 1, "list": [1, 2]}}, {"n": None}]))
    rows = {r.row_no: r for r in records.json_records(spark, str(tmp_path)).collect()}
    assert rows[1].fields == {"source_file": "r.json", "name_one": "x", "in_a": "1", "in_list": "1,2"} and rows[2].logical_name == "records"


def test_xml_records_from_splits(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(records, "PART_PIECES", 3)
    body = "".join(f'<Event id="{k}"><name>n{k}</name>\n<who><user>u{k % 3}</user></who></Event>' for k in range(150))
    (tmp_path / "log.xml").write_text(f'<?xml version="1.0"?><log made="x">{body}</log>')
    assert records.row_tag(spark, str(tmp_path)) == "Event"
    rows = sorted(records.xml_records(spark, str(tmp_path)).collect(), key=lambda r: r.row_no)
    assert [r.row_no for r in rows] == list(range(1, 151)) and {r.logical_name for r in rows} == {"event"}
    assert [(r.fields["id"], r.fields["name"], json.loads(r.fields["who"])) for r in rows] == [(str(k), f"n{k}", {"user": f"u{k % 3}"}) for k in range(150)]


TEXTS = {"a.log": b"one\ntwo\r\nthree\rfour\n", "b/c.log": "caf\u00e9\u2028x\x0by".encode(), "latin.log": b"caf\xe9\n\nend", "empty.log": b"", "blank.log": b"\n\n", "cr.log": b"x\r", "long.log": b"y" * 5000 + b"\nz"}


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in TEXTS.items():
            z.writestr(k, v)
    return out.getvalue()


def _tar(mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as t:
        for k, v in TEXTS.items():
            info = tarfile.TarInfo(k)
            info.size = len(v)
            t.addfile(info, io.BytesIO(v))
    return out.getvalue()


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_lines_of_members(monkeypatch, chunk):
    monkeypatch.setattr(archives, "CHUNK", chunk)
    for raw in TEXTS.values():
        text = raw.decode() if archives._is_utf8(lambda: io.BytesIO(raw)) else raw.decode("latin-1")
        assert list(archives.lines_in(lambda: io.BytesIO(raw))) == text.splitlines()


def test_archive_lines_equal_a_whole_read(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(_zip())
    (tmp_path / "x.tar").write_bytes(_tar("w"))
    (tmp_path / "x.log.gz").write_bytes(gzip.compress(TEXTS["a.log"]))
    (tmp_path / "plain.log").write_bytes(TEXTS["latin.log"])
    (tmp_path / "broken.zip").write_bytes(b"PK\x03\x04 no zip")
    whole = lines_of(sources.decode_bytes(sources.read_files(spark, str(tmp_path))))
    want = sorted((r.filename, r.line_no, r.line) for r in whole.collect())
    got = sorted((r.filename, r.line_no, r.line) for r in archives.read_archive_lines(spark, str(tmp_path)).collect())
    assert got == want and len({r[0] for r in got}) > 10


def test_packed_tar_and_a_member_beyond_any_batch(spark, tmp_path):
    (tmp_path / "x.tgz").write_bytes(_tar("w:gz"))
    n = 400_000
    line = "0123456789" * 4
    big = io.BytesIO((line + "\n").encode() * n)  # 16 MB, unpacked in chunks of 1 MB
    with tarfile.open(tmp_path / "big.tar", "w") as t:
        info = tarfile.TarInfo("big.log")
        info.size = big.getbuffer().nbytes
        t.addfile(info, big)
    d = archives.read_archive_lines(spark, str(tmp_path))
    of = d.groupBy("filename").count().collect()
    assert {r.filename: r["count"] for r in of}["big.tar:big.log"] == n and {r.filename: r["count"] for r in of}["x.tgz:a.log"] == 4
    assert d.where("filename = 'big.tar:big.log'").selectExpr("max(line_no)", "count(distinct line)").first()[:] == (n, 1)
