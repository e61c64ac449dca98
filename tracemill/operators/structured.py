"""JSON, delimited and XML files as records (file_id, filename, logical_name, row_no, fields).

fields maps sanitized keys to text. JSON lines and delimited text stay in the
JVM; whole JSON and XML documents, whose trees have no fixed schema, are walked
by a small function for each file in Arrow batches. A file is one document and
is read whole, as its format asks.
"""

from __future__ import annotations

import hashlib
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars as S
from ..sources.shared import once
from .line_parsers import RAW_CHARS, last_wins, numbered_rows

RECORDS = "file_id string, filename string, logical_name string, row_no long, fields map<string,string>"
UNITS = "file_id string, filename string, start_line long, end_line long, raw string, fields map<string,string>, confidence double"
#: How deep nested objects get columns of their own; deeper ones are JSON text.
DEPTH = 4
# Names of the counts of well-known lists.
COUNT_NAMES = {"chambers": "chamber_count", "wafers": "wafer_count", "steps": "step_count", "alarms": "alarm_count"}


# -- helpers for one value ---------------------------------------------------------


def _name(key: str) -> str:
    s = re.sub(r"_+", "_", re.sub(r"[^\w]", "_", key.strip())).strip("_").lower() or "field"
    s = f"field_{s}" if s[0].isdigit() else s
    return s if len(s) <= S.MAX_IDENTIFIER else s[:54].rstrip("_") + "_" + hashlib.md5(s.encode()).hexdigest()[:8]


def _free(name: str, taken: dict) -> str:
    k, free = 2, name
    while free in taken:
        k, free = k + 1, f"{name}_{k}"
    return free


def _text(v: Any) -> str | None:
    """The text of a scalar as the type inference reads it again."""
    if v is None or isinstance(v, str):
        return v
    return str(v).lower() if isinstance(v, bool) else str(v)


def _joined(items: list) -> str:
    return ",".join(str(x) if not isinstance(x, str) else x.strip() for x in items)


def _dump(v: Any) -> str:
    return json.dumps(v, ensure_ascii=True)


def _scalar(v: Any) -> bool:
    return not isinstance(v, (dict, list))


def leaves(value: Any, name: str = "", longest: int | None = 10) -> Iterator[tuple[str, str | None]]:
    """(name, text) of whatever has no members of its own, in document order; what lies more than DEPTH objects deep is one leaf.

    A name joins the keys on the way. Lists of scalars (up to longest; None: any)
    are comma-joined, other lists are JSON.
    """
    ahead = [(name, 0, value)]
    while ahead:
        name, level, v = ahead.pop()
        if isinstance(v, dict) and level <= DEPTH:
            ahead += reversed([("_".join(filter(None, (name, _name(k)))), level + 1, x) for k, x in v.items()])
        elif isinstance(v, list) and all(map(_scalar, v)) and len(v) <= (longest or len(v)):
            yield name, _joined(v)
        else:
            yield name, _text(v) if _scalar(v) else _dump(v)


def flatten(value: Any, into: dict | None = None, **how) -> dict[str, str | None]:
    """The leaves as a dict, names that are taken numbered; how is passed on to leaves()."""
    out = {} if into is None else into
    for name, text in leaves(value, **how):
        out[_free(name, out)] = text
    return out


def json_document(filename: str, content: str) -> list[tuple[str, dict[str, str | None]]]:
    """(logical name, fields) of a JSON document: run and a table for each list of objects, or records of a root list."""
    try:
        root = json.loads(content)
    except ValueError:
        return []
    own = hashlib.md5(filename.encode()).hexdigest()[:12]
    if isinstance(root, list):
        return [("records", {"source_file": filename, "document_id": f"{own}_{k}"} | flatten(x, longest=None)) for k, x in enumerate(root, 1) if isinstance(x, dict)]
    if not isinstance(root, dict):
        return []
    document = str(root.get("run_id") or f"{own}_1")
    parent: dict[str, str | None] = {"document_id": document, "source_file": filename}
    children: list[tuple[str, dict]] = []
    for key, v in root.items():
        name = _name(key)
        if isinstance(v, dict) and name == "result":
            for k, x in v.items():
                parent["result_status" if _name(k) == "status" else _name(k)] = _text(x) if _scalar(x) else _dump(x)
        elif isinstance(v, dict):
            flatten(v, parent, name=name, longest=None)
        elif isinstance(v, list):
            parent[COUNT_NAMES.get(name, f"{name}_count")] = str(len(v))
            if v and all(isinstance(x, dict) for x in v):
                for k, x in enumerate(v, 1):
                    row = {"document_id": document, "item_index": str(k)} | flatten(x, longest=None)
                    if "run_id" in root:
                        row.setdefault("run_id", _text(root["run_id"]) if _scalar(root["run_id"]) else _dump(root["run_id"]))
                    children.append((name, row))
            elif v:
                parent[name] = _joined(v) if all(map(_scalar, v)) else _dump(v)
        else:
            parent[name] = _text(v)
    return [("run", parent), *children]


# The tables of a recipe document: (table, step child or none, {column: attribute}).
RECIPE = {"setpoint": ("recipe_setpoints", {"setpoint_name": "name", "setpoint_value": "value"}), "interlock": ("recipe_interlocks", {"interlock_name": "name", "interlock_required": "required"}), "tolerance": ("recipe_tolerances", {"tolerance_name": "name", "tolerance_low": "low", "tolerance_high": "high"})}


#: Columns of the recipe table: the element (below the root, or the root itself) and its attribute.
RECIPE_HEAD = {"tool": (".", "tool"), "chamber": (".", "chamber"), "recipe_name": (".", "name"), "version": (".", "version"), "author": (".", "author")} | {c: ("metadata", c) for c in ("created_ts", "approved_by", "product")}


def _recipe(root: ET.Element, filename: str) -> list[tuple[str, dict]]:
    own = f"{root.get('name')}:{root.get('version', '')}" if root.get("name") else hashlib.md5(filename.encode()).hexdigest()[:12]
    found = {c: (root if at == "." else root.find(at), attribute) for c, (at, attribute) in RECIPE_HEAD.items()}
    head = {c: e.get(attribute) for c, (e, attribute) in found.items() if e is not None}
    head |= {c: head[c] or None for c in ("recipe_name", "version")}
    out = [("recipe", {"source_file": filename, "recipe_id": own} | head)]
    for step in root.findall("step"):
        seq = {"recipe_id": own, "step_seq": step.get("seq")}
        out.append(("recipe_steps", seq | {"step_name": step.get("name"), "duration_s": step.get("duration_s")}))
        for tag, (table, columns) in RECIPE.items():
            out += [(table, seq | {c: x.get(a) for c, a in columns.items()}) for x in step.findall(tag)]
    return out


def _local(tag: str) -> str:
    return _name(tag.rpartition("}")[2])


def _walk(e: ET.Element, context: dict, out: list) -> None:
    row = dict(context)
    for k, v in e.attrib.items():
        row.setdefault(_name(k.rpartition("}")[2]), v)
    below: dict[str, list[ET.Element]] = {}
    for child in e:
        below.setdefault(_local(child.tag), []).append(child)
    nested = []
    for tag, same in below.items():
        leaf = not any(len(c) for c in same)
        if len(same) == 1 and leaf:
            if text := (same[0].text or "").strip():
                row[_free(tag, row)] = text
            for k, v in same[0].attrib.items():
                row[_free(f"{tag}_{_name(k.rpartition('}')[2])}", row)] = v
        elif leaf:
            nested += [(tag, context | {"item_index": str(k), "value": (c.text or "").strip() or None} | {_name(a.rpartition("}")[2]): v for a, v in c.attrib.items()}) for k, c in enumerate(same, 1)]
        else:
            nested += [(tag, c) for c in same]
    out.append((_local(e.tag), row))
    for tag, x in nested:
        if isinstance(x, dict):
            out.append((tag, x))
        else:
            _walk(x, context, out)


def xml_document(filename: str, content: str) -> list[tuple[str, dict[str, str | None]]]:
    """(logical name, fields) of an XML document: the recipe tables, or a table for each element with attributes or children.

    Every complex element gives one row, leaf children become its columns, and
    repeated leaves become rows of their own.
    """
    if "<!ENTITY" in content:
        return []
    try:
        root = ET.fromstring(content.strip())
    except (ET.ParseError, ValueError):
        return []
    if _local(root.tag) == "recipe":
        return _recipe(root, filename)
    out: list[tuple[str, dict]] = []
    _walk(root, {"source_file": filename, "document_id": hashlib.md5(filename.encode()).hexdigest()[:12]}, out)
    return out


def xml_fields(text: str) -> dict[str, str]:
    """All attributes and leaf texts of one element as a flat map."""
    try:
        root = ET.fromstring(text)
    except (ET.ParseError, ValueError):
        return {}
    out: dict[str, str] = {}
    for k, v in root.attrib.items():
        out[_free(f"attr_{_name(k)}", out)] = v
    for e in root.iter():
        if e is not root:
            tag = _local(e.tag)
            if not len(e) and (e.text or "").strip():
                out[_free(tag, out)] = e.text.strip()
            for k, v in e.attrib.items():
                out[_free(f"{tag}_attr_{_name(k)}", out)] = v
    return out


#: Documents whose records make up a batch.
BATCH_DOCUMENTS = 1000


def _documents(read):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH_DOCUMENTS):
                part = batch.slice(a, BATCH_DOCUMENTS)
                of, tables, nth, keys, values, ends = [], [], [], [], [], [0]
                for k, (filename, content) in enumerate(zip(part.column("filename").to_pylist(), part.column("content").to_pylist())):
                    count: dict[str, int] = {}
                    for name, fields in read(filename, content):
                        count[name] = count.get(name, 0) + 1
                        of.append(k)
                        tables.append(name)
                        nth.append(count[name])
                        keys += fields
                        values += fields.values()
                        ends.append(len(keys))
                rows = pa.array(of, pa.int64())
                maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
                columns = [part.column("file_id").take(rows), part.column("filename").take(rows), pa.array(tables, pa.string()), pa.array(nth, pa.int64()), maps]
                yield pa.RecordBatch.from_arrays(columns, ["file_id", "filename", "logical_name", "row_no", "fields"])

    return each


def json_documents(files: DataFrame) -> DataFrame:
    return files.select("file_id", "filename", "content").mapInArrow(_documents(json_document), RECORDS)


def xml_documents(files: DataFrame) -> DataFrame:
    return files.select("file_id", "filename", "content").mapInArrow(_documents(xml_document), RECORDS)


# -- JSON lines --------------------------------------------------------------------


def json_value_fields(c: Column) -> Column:
    """The first level of a JSON object as map(sanitized key, text); nested values are JSON text. Null if c is none."""
    m = F.from_json(F.when(S.is_json(c), c), "map<string,string>")
    return F.map_from_entries(F.transform(F.map_entries(m), lambda e: F.struct(S.sanitize_identifier(e["key"]).alias("key"), e["value"].alias("value"))))


def json_map(rows: DataFrame, column: str) -> DataFrame:
    """The rows whose column is a JSON object with its fields; nested objects become a_b keys, DEPTH levels deep."""
    text = F.trim(column)
    d = rows.where(F.startswith(text, F.lit("{")) & S.is_json(text)).withColumn("e", F.map_entries(F.from_json(text, "map<string,string>")))
    # a filter that moved down would repeat what stands below it three times for each level
    d = once(d).where("e is not null")
    for _ in range(DEPTH):
        nested = F.exists("e", lambda x: F.coalesce(F.startswith(x["value"], F.lit("{")), F.lit(False)))
        d = d.withColumn("e", F.when(nested, F.flatten(F.transform("e", _one_level))).otherwise(F.col("e")))
    joined = F.transform("e", lambda e: F.struct(S.sanitize_identifier(e["key"]).alias("k"), _list_text(e["value"]).alias("v")))
    return once(d.withColumn("fields", last_wins(F.filter(joined, lambda e: e["k"] != "source_file"))).drop("e"))


def json_lines(lines: DataFrame) -> DataFrame:
    """A record for each line that holds an object."""
    d = json_map(lines, "line")
    fields = F.map_concat(F.create_map(F.lit("source_file"), F.col("filename")), "fields")
    return d.select("file_id", "filename", F.lit("json_records").alias("logical_name"), F.col("line_no").alias("row_no"), fields.alias("fields"))


def _whole_units(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for r in frame.itertuples():
            try:
                root = json.loads(r.content)
            except ValueError:  # what JSON readers differ in
                continue
            if isinstance(root, dict):
                rows.append((r.file_id, r.filename, 1, len(r.content.splitlines()), r.content.strip()[:RAW_CHARS], flatten(root), 0.98))
            elif isinstance(root, list):
                rows += [(r.file_id, r.filename, k, k, _dump(x), flatten(x), 0.97) for k, x in enumerate(root, 1) if isinstance(x, dict)]
        yield pd.DataFrame(rows, columns=["file_id", "filename", "start_line", "end_line", "raw", "fields", "confidence"])


def json_units(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Units of JSON files: a document that is one object whole, the objects of one that is a list, else each line that holds an object."""
    is_whole = F.coalesce(S.is_json(F.trim("content")), F.lit(False))
    whole = files.where(is_whole).select("file_id", "filename", "content").mapInPandas(_whole_units, UNITS)
    each = json_map(lines.join(files.where(is_whole).select("file_id"), "file_id", "left_anti"), "line")
    each = each.select("file_id", "filename", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.trim("line").alias("raw"), "fields", F.lit(0.95).alias("confidence"))
    return whole.unionByName(each)


def _one_level(e: Column) -> Column:
    inner = F.from_json(F.when(F.startswith(e["value"], F.lit("{")), e["value"]), "map<string,string>")
    opened = F.transform(F.map_entries(inner), lambda x: F.struct(F.concat(e["key"], F.lit("_"), x["key"]).alias("key"), x["value"].alias("value")))
    return F.coalesce(opened, F.array(F.struct(e["key"].alias("key"), e["value"].alias("value"))))


def _list_text(v: Column) -> Column:
    items = F.from_json(F.when(F.startswith(v, F.lit("[")), v), "array<string>")
    plain = (F.size(items) <= 10) & ~v.rlike(r"^\[[\s\S]*[\[{]")
    return F.when(items.isNotNull() & plain, F.array_join(items, ",")).otherwise(v)


def invalid_json(lines: DataFrame) -> DataFrame:
    """Warnings for non-blank lines that are no JSON object."""
    text = F.trim("line")
    valid = S.is_json(text)
    reason = F.when(~valid, "invalid JSON object").otherwise("JSON value is not an object")
    return lines.where((text != "") & (~valid | ~F.startswith(text, F.lit("{")))).select("file_id", "filename", "line_no", F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), reason).alias("warning"))


# -- delimited text ----------------------------------------------------------------

_MARKS = (",", "\t", "|", ";")


def sniff(lines: DataFrame) -> DataFrame:
    """file_id, delimiter, has_header, header, width from the first ten non-blank lines of each file.

    The delimiter scores consistency times count of its columns; the first line
    is a header if it is as wide as the second and at least six in ten of its
    cells are no numbers, dates or empty, and the next line has one that is.
    """
    w = Window.partitionBy("file_id").orderBy("line_no")
    top = lines.where(F.trim("line") != "").withColumn("pos", F.row_number().over(w)).where("pos <= 10")
    counts = [(F.length("line") - F.length(F.replace("line", F.lit(m), F.lit("")))).alias(f"n{k}") for k, m in enumerate(_MARKS)]
    d = top.select("file_id", "pos", "line", *counts)
    first = F.min_by(F.struct("line", *[f"n{k}" for k in range(len(_MARKS))]), "pos")
    g = d.groupBy("file_id").agg(first.alias("h"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("told"))
    score = lambda k, m: F.when(F.col(f"h.n{k}") > 0, F.size(F.filter("told", lambda x: F.length(x["line"]) - F.length(F.replace(x["line"], F.lit(m), F.lit(""))) == F.col(f"h.n{k}"))) / F.size("told") * (F.col(f"h.n{k}") + 1)).otherwise(0.0)
    best = F.array_max(F.array(*[F.struct(score(k, m).alias("score"), F.lit(-k).alias("rank"), F.lit(m).alias("mark")) for k, m in enumerate(_MARKS)]))
    g = g.withColumn("best", best).withColumn("delimiter", F.when(F.col("best.score") > 0, F.col("best.mark")).otherwise(","))
    cells = lambda x: F.transform(_cells(x, F.col("delimiter")), lambda c: F.trim(c))
    g = g.withColumn("header", cells(F.col("told")[0]["line"])).withColumn("second", cells(F.get(F.col("told"), F.lit(1))["line"]))
    value = lambda c: c.rlike(r"^[+-]?\d+(\.\d+)?$|^\d{4}-\d{2}-\d{2}") | (c == "")
    words = F.size(F.filter("header", lambda c: ~value(c)))
    has = (F.size("told") > 1) & (F.size("header") == F.size("second")) & (words >= 0.6 * F.size("header")) & F.exists("second", value)
    return g.select("file_id", "delimiter", F.coalesce(has, F.lit(False)).alias("has_header"), "header", F.array_max(F.transform("told", lambda x: F.size(_cells(x["line"], F.col("delimiter"))))).alias("width"))


def _cells(line: Column, mark: Column) -> Column:
    """The cells of a line; marks inside double quotes don't divide."""
    masked = F.regexp_replace(line, r'"([^"]*)"', "$1")
    quoted = F.contains(line, F.lit('"'))
    # outside of quotes the mark becomes a unit separator
    parts = F.split(line, '"')
    out = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 0, F.replace(p, mark, F.lit("\x1f"))).otherwise(p)), "")
    return F.when(quoted, F.split(out, "\x1f")).otherwise(F.split(F.replace(masked, mark, F.lit("\x1f")), "\x1f"))


def delimited(lines: DataFrame) -> DataFrame:
    """A record for each line of delimited files: header names sanitized and made unique, short rows padded with empty text.

    Without a header there are as many columns as the widest line of the file has cells.
    """
    meta = sniff(lines).drop("width")
    wide = F.max(F.when(~F.col("has_header"), F.size(_cells(F.col("line"), F.col("delimiter"))))).alias("width")
    told = lines.where(F.trim("line") != "").join(meta.select("file_id", "delimiter", "has_header"), "file_id")
    meta = meta.join(told.groupBy("file_id").agg(wide), "file_id")
    name = F.transform("header", lambda c: S.sanitize_identifier(c))
    numbered = F.transform(F.sequence(F.lit(1), F.greatest("width", F.lit(1))), lambda k: F.concat(F.lit("column_"), k.cast("string")))
    names = F.when(F.col("has_header"), name).otherwise(numbered)
    unique = lambda a: F.transform(a, lambda c, i: F.concat(c, F.when(F.size(F.filter(F.slice(a, 1, i + 1), lambda x: x == c)) > 1, F.concat(F.lit("_"), F.size(F.filter(F.slice(a, 1, i + 1), lambda x: x == c)).cast("string"))).otherwise("")))
    meta = meta.withColumn("names0", names).withColumn("names", unique(F.col("names0"))).drop("names0", "header", "width")
    d = numbered_rows(lines.where(F.trim("line") != "")).join(meta, "file_id").where(~F.col("has_header") | (F.col("row_no") > 1))
    d = d.withColumn("row_no", F.col("row_no") - F.col("has_header").cast("long")).withColumn("cells", _cells(F.col("line"), F.col("delimiter")))
    values = F.transform("names", lambda n, i: F.trim(F.coalesce(F.get(F.col("cells"), i), F.lit(""))))
    fields = F.map_concat(F.create_map(F.lit("source_file"), F.col("filename")), F.map_from_entries(F.filter(F.arrays_zip(F.col("names").alias("k"), values.alias("v")), lambda e: e["k"] != "source_file")))
    return d.select("file_id", "filename", S.logical_name(F.col("filename")).alias("logical_name"), "row_no", fields.alias("fields"))


def comma_units(lines: DataFrame) -> DataFrame:
    """Units of comma-separated files: each line after the first non-blank one, cells under its names, the last of equal names.

    Cells that a short line lacks are no fields, cells beyond the names are left out.
    """
    told = lines.where(F.col("line").rlike(r"\S"))
    heads = told.groupBy("file_id").agg(F.min(F.struct("line_no", "line")).alias("head"))
    d = told.join(heads, "file_id").where(F.col("line_no") > F.col("head.line_no"))
    cells = lambda c: _cells(c, F.lit(","))
    pairs = F.arrays_zip(cells(F.col("head.line")).alias("k"), cells(F.col("line")).alias("v"))
    own = F.filter(pairs, lambda e: e["k"].isNotNull() & e["v"].isNotNull())
    fields = last_wins(F.transform(own, lambda e: F.struct(S.sanitize_identifier(e["k"]).alias("k"), F.trim(e["v"]).alias("v"))))
    return d.select("file_id", "filename", F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("raw"), fields.alias("fields"), F.lit(0.95).alias("confidence"))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _xml_map(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: xml_fields(t) if isinstance(t, str) and t.startswith("<") and "<!ENTITY" not in t else {})


def with_xml_fields(units: DataFrame) -> DataFrame:
    """Units whose raw is one XML element get its attributes and leaves as fields, with confidence .9."""
    d = units.withColumn("xml", _xml_map(F.trim("raw")))
    own = F.size("xml") > 0
    return d.withColumn("fields", F.when(own, F.col("xml")).otherwise(F.col("fields"))).withColumn("confidence", F.when(own, 0.9).otherwise(F.col("confidence"))).drop("xml")
