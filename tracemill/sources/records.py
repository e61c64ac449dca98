"""Records of files that no task can hold: one huge JSON list or XML document, read from splits by many tasks.

Spark's text reader divides a file at any mark, so a JSON file comes as pieces
that end in "}" and an XML file as pieces that end in the record's closing tag,
each with its place in the file. What a piece of JSON means hangs on what stands
before it: whether it begins within a string, and how deep. Both are prefix sums
over the file (of quotes, of brackets), taken in two steps, so no task ever holds
a file, only the pieces of a record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.structured import RECORDS, json_map
from .shared import once, written

#: Pieces that are summed in one task; a longer split is cut by them.
PART_PIECES = 4096


def _pieces(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """file_id, filename, start (of the split), at (the piece's place in it), text without the mark."""
    raw = spark.read.option("lineSep", mark).text(path)
    raw = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    return raw.select(F.substring(F.md5("path"), 1, 12).alias("file_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "start", "at", "text")


def _with_sum_before(d: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Pieces with the sum of each column over all pieces of the file before them: within a part by a window, and over parts."""
    d = d.withColumns({f"__{k}": c for k, c in sums.items()})
    order = Window.partitionBy("file_id", "start", "part").orderBy("at")
    inside = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("file_id", "start", "part").agg(*[F.sum(f"__{k}").alias(f"held_{k}") for k in sums])
    before = Window.partitionBy("file_id").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("file_id", "start", "part", *[F.coalesce(F.sum(f"held_{k}").over(before), F.lit(0)).alias(f"base_{k}") for k in sums])
    d = d.withColumns({f"in_{k}": F.coalesce(F.sum(f"__{k}").over(inside), F.lit(0)) for k in sums}).join(parts, ["file_id", "start", "part"])
    return d.withColumns({k: F.col(f"base_{k}") + F.col(f"in_{k}") for k in sums}).drop(*[f"{p}_{k}" for k in sums for p in ("base", "in")], *[f"__{k}" for k in sums])


def _count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def json_items(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, filename, row_no, item): the objects of JSON files whose root is a list, or that hold objects one after another.

    row_no counts a file's objects from 1 in the order of the file. Scalars and
    lists among them are left out. An object is what one row holds, however long
    the file. Path and options are Spark's, so splits are those of
    spark.sql.files.maxPartitionBytes.
    """
    d = _pieces(spark, path, "}").withColumn("part", F.floor(F.col("at") % 2**33 / PART_PIECES))
    bare = F.regexp_replace("text", r"\\.", "")  # no escape can cross a piece, for none ends in a bracket
    d = d.withColumn("quotes", _count(bare, '"'))
    # what lies outside of strings, if the piece begins outside of one (0), or inside (1)
    told = F.split(bare, '"')
    outside = lambda odd: F.array_join(F.filter(told, lambda x, i: i % 2 == odd), " ")
    depth = lambda c: _count(c, r"[\[{]") - _count(c, r"\]")
    d = written(d.withColumns({"even": depth(outside(0)), "odd": depth(outside(1)), "list": outside(0).rlike(r"^[\s\x{FEFF}]*\[")}))
    # numbers alone go through the sums
    n = _with_sum_before(d.drop("text", "filename"), {"quoted": F.col("quotes")})
    inside = F.pmod("quoted", F.lit(2)) == 1
    closes = F.pmod(F.col("quoted") + F.col("quotes"), F.lit(2)) == 0  # the bracket that ends the piece is one
    n = n.withColumn("change", F.when(inside, F.col("odd")).otherwise(F.col("even")) - closes.cast("int")).withColumn("closes", closes)
    n = _with_sum_before(written(n.drop("quotes", "even", "odd", "quoted")), {"depth": F.col("change")})
    heads = n.groupBy("file_id").agg(F.min_by("list", F.struct("start", "at")).alias("in_list"))
    n = n.join(heads, "file_id").withColumn("ends", (F.col("closes") & (F.col("depth") + F.col("change") == F.col("in_list").cast("int"))).cast("int"))
    n = _with_sum_before(written(n.select("file_id", "start", "part", "at", "ends")), {"nth": F.col("ends")})
    d = d.select("file_id", "filename", "start", "at", "text").join(n.select("file_id", "start", "at", "ends", "nth"), ["file_id", "start", "at"])
    told = F.sort_array(F.collect_list(F.struct("start", "at", "text")))
    whole = d.groupBy("file_id", "filename", "nth").agg(F.max("ends").alias("ends"), told.alias("told")).where("ends = 1")
    text = F.array_join(F.transform("told", lambda x: F.concat(x["text"], F.lit("}"))), "")
    # before the object may stand scalars and lists, which are no records: a list of all that was gathered tells them apart
    body = F.regexp_replace(text, r"^[\s\x{FEFF}]*[\[,]?", "")
    items = F.from_json(F.concat(F.lit("["), body, F.lit("]")), "array<string>")
    item = F.try_element_at(items, F.lit(-1))
    told = once(whole.select("file_id", "filename", (F.col("nth") + 1).cast("long").alias("row_no"), item.alias("item")))
    return told.where(F.startswith("item", F.lit("{")))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """json_items() as records (file_id, filename, logical_name, row_no, fields), fields as those of lines that hold an object."""
    d = json_map(json_items(spark, path), "item")
    fields = F.map_concat(F.create_map(F.lit("source_file"), F.col("filename")), "fields")
    return d.select("file_id", "filename", F.lit("records").alias("logical_name"), "row_no", fields.alias("fields"))


def row_tag(spark: SparkSession, path: str, most: int = 1000) -> str | None:
    """The element below the root that an XML file's first elements tell: the first one that comes again. A bounded look at its head."""
    heads = [r.value for r in spark.read.option("lineSep", ">").text(path).limit(most).select(F.substring_index("value", "<", -1).alias("value")).collect()]
    seen: set[str] = set()
    depth = 0
    for h in heads:
        name = h.split()[0].rstrip("/") if h.split() else ""
        if h[:1] in "?!" or not name:
            continue
        if h.startswith("/"):
            depth -= 1
            continue
        if depth == 1:
            if name in seen:
                return name
            seen.add(name)
        depth += not h.endswith("/")
    return next(iter(sorted(seen)), None)


def xml_records(spark: SparkSession, path: str, tag: str | None = None) -> DataFrame:
    """Each element named tag below the root of XML files as a record: attributes, leaves and what is nested in it as JSON.

    Read by Spark's XML source, which resynchronises in each split at the next
    opening tag. Element and attribute names are made identifiers; an element
    that can't be read has its text in malformed.
    """
    tag = tag or row_tag(spark, path)
    if tag is None:
        return spark.createDataFrame([], RECORDS)
    reader = spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "").option("valueTag", "value").option("columnNameOfCorruptRecord", "malformed").option("inferSchema", "false")
    d = reader.load(path)
    own = [c for c in d.columns]
    text = lambda c: F.to_json(F.col(f"`{c}`")) if dict(d.dtypes)[c].startswith(("struct", "array", "map")) else F.col(f"`{c}`").cast("string")
    place = d.select(*[F.col(f"`{c}`") for c in own], F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    file_id = F.substring(F.md5("__path"), 1, 12).alias("file_id")
    pairs = F.map_from_arrays(F.array(*[S.sanitize_identifier(F.lit(c)) for c in own]), F.array(*[text(c) for c in own]))
    fields = F.map_filter(pairs, lambda k, v: v.isNotNull())
    d = place.select(file_id, F.element_at(F.split("__path", "/"), -1).alias("filename"), S.sanitize_identifier(F.lit(tag)).alias("logical_name"), F.col("__start").alias("start"), F.col("__at").alias("at"), fields.alias("fields"))
    d = _with_sum_before(d.withColumn("part", F.floor(F.col("at") % 2**33 / PART_PIECES)), {"before": F.lit(1)})
    return d.select("file_id", "filename", "logical_name", (F.col("before") + 1).alias("row_no"), "fields")
