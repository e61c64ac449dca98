"""Format detection: one aggregation over the sampled lines of each file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from ..functions import patterns as P
from ..functions import scalars as S
from ..sources import files as files_of
from ..sources.lines import sample
from ..sources.shared import written

# Formats in the order that breaks ties.
FINGERPRINT_FORMATS = ("json_lines", "json_document", "xml", "csv", "syslog", "apache_clf", "logfmt", "key_value", "hex_dump", "section_delimited")
SERVICE_FORMATS = ("json_lines", "xml", "csv", "syslog", "nginx_access", "apache_access", "logfmt", "key_value")
STRUCTURED = ("json_lines", "json_document", "xml", "csv", "syslog", "apache_clf", "apache_access", "nginx_access", "logfmt")
SEMI_STRUCTURED = ("key_value", "section_delimited")
FINGERPRINT_TO_FORMAT = {"json_lines": "json_lines", "json_document": "json_lines", "xml": "xml", "csv": "csv", "syslog": "syslog", "apache_clf": "apache_access", "logfmt": "logfmt", "key_value": "key_value", "section_delimited": "key_value", "hex_dump": "hex_dump", "plain_text": "plain_text"}
PARSERS = {"json_lines": "json_lines", "xml": "xml", "csv": "csv", "syslog": "syslog", "apache_access": "apache_access", "nginx_access": "nginx_access", "logfmt": "logfmt", "key_value": "key_value", "hex_dump": "binary_hex"}
#: Settles what content leaves open.
EXTENSIONS = {"json": "json_lines", "ndjson": "json_lines", "jsonl": "json_lines", "csv": "csv", "tsv": "csv", "xml": "xml", "hex": "binary_hex", "dump": "binary_hex", "bin": "binary_hex"}
#: Parsers that claim content, in the order in which equal claims are taken.
PARSER_KEYS = ("json_lines", "csv", "xml", "syslog", "apache_access", "nginx_access", "logfmt", "key_value", "binary_hex")
DELIMITERS = {"comma": ",", "tab": "\t", "pipe": "|", "equals": "=", "colon": ":"}


def _share(hit: Column) -> Column:
    return F.avg(F.when(hit, 1.0).otherwise(0.0))


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def _best(scores: dict[str, Column]) -> Column:
    """struct(score, format) of the highest positive score, the first of equals; null if there is none."""
    ranked = F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("rank"), F.lit(f).alias("format")) for k, (f, s) in enumerate(scores.items())])
    return F.array_max(F.filter(ranked, lambda x: x["score"] > 0))


_CSV_MARKS = (",", "\t", "|", ";")


def _headed(lines: DataFrame, marks: tuple[str, ...], order: str = "pos") -> DataFrame:
    """Sampled lines with how often each mark occurs in them (n0, ...) and in their file's first (h0, ...)."""
    first = Window.partitionBy("file_id").orderBy(order)
    counted = lines.withColumns({f"n{k}": _count(F.col("line"), m) for k, m in enumerate(marks)})
    return counted.withColumns({f"h{k}": F.first(f"n{k}").over(first) for k in range(len(marks))})


def _csv_share(k: int, within: Column | None = None) -> Column:
    """Of the lines 2 to 10, the share with as many marks as the first."""
    later = (F.col("pos") > 1) & (F.col("pos") <= 10)
    later = later if within is None else later & within
    same = (F.col(f"h{k}") > 0) & (F.col(f"n{k}") == F.col(f"h{k}"))
    return F.coalesce(F.avg(F.when(later, F.when(same, 1.0).otherwise(0.0))), F.lit(0.0))


def delimiter_score(lines: DataFrame, marks: tuple[str, ...] = (",",)) -> DataFrame:
    """file_id, csv: how regular the columns of a sample are, for the best of some marks."""
    shares = [_csv_share(k) for k in range(len(marks))]
    return _headed(lines, marks).groupBy("file_id").agg((F.greatest(*shares) if len(shares) > 1 else shares[0]).alias("csv"))


#: Patterns that scores and statistics count.
_ASKED = {"json": P.JSON_LINE, "xml": P.XML_TAG, "syslog": P.SYSLOG_START, "access": P.ACCESS_START, "logfmt": P.LOGFMT_LINE, "pairs": P.KEY_VALUE_LINE, "hex": P.HEX_DUMP_START, "section": P.SECTION_HEADER, "stamp": P.ISO_TIMESTAMP, "level": P.LEVEL_HINT}


def _asked(lines: DataFrame) -> DataFrame:
    """lines with is_*: whether each pattern matches, asked once of a line however many aggregates count it."""
    return lines.withColumns({f"is_{k}": F.col("line").rlike(p) for k, p in _ASKED.items()})


def _stat_columns() -> list[Column]:
    n = F.length("line")
    return [
        F.count("*").alias("sample_lines"),
        F.bround(F.avg(n), 1).alias("avg_line_length"),
        F.bround(F.stddev_pop(n), 1).alias("line_length_std"),
        (_share(F.col("is_stamp")) > 0.3).alias("has_timestamps"),
        (_share(F.col("is_level")) > 0.3).alias("has_log_levels"),
    ]


def line_stats(lines: DataFrame) -> DataFrame:
    """Average and population deviation of line lengths, whether timestamps and levels are frequent."""
    return _asked(lines).groupBy("file_id").agg(*_stat_columns())


def delimiter_counts(lines: DataFrame) -> DataFrame:
    """How often each delimiter occurs in the first 50 sampled lines."""
    return lines.where("pos <= 50").groupBy("file_id").agg(*[F.sum(_count(F.col("line"), m)).alias(k) for k, m in DELIMITERS.items()])


def _heads() -> Column:
    """The first 20 sampled lines, 200 characters each."""
    return F.sort_array(F.collect_list(F.when(F.col("pos") <= 20, F.struct("pos", F.substring("line", 1, 200).alias("head"))))).alias("told")


def _hash_of_heads() -> Column:
    return F.substring(F.sha2(F.array_join(F.transform("told", lambda x: x["head"]), "\n"), 256), 1, 16).alias("fingerprint")


def content_fingerprint(lines: DataFrame) -> DataFrame:
    """The first 16 hex digits of the SHA-256 of a sample's first lines."""
    return lines.where("pos <= 20").groupBy("file_id").agg(_heads()).select("file_id", _hash_of_heads())


def _score_columns() -> list[Column]:
    c = F.col("line")
    json = _share(F.col("is_json"))
    opened = F.avg(F.when(F.col("pos") <= 10, F.when(c.rlike(P.JSON_OPEN), 1.0).otherwise(0.0)))
    return [
        json.alias("json_lines"),
        F.when(json == 0, F.least(F.lit(0.85), opened)).otherwise(0.0).alias("json_document"),
        _share(F.col("is_xml")).alias("xml"),
        _csv_share(0).alias("csv"),
        _share(F.col("is_syslog")).alias("syslog"),
        _share(F.col("is_access")).alias("apache_clf"),
        _share(F.col("is_logfmt")).alias("logfmt"),
        (_share(F.col("is_pairs")) * 0.8).alias("key_value"),
        _share(F.col("is_hex")).alias("hex_dump"),
        _share(F.col("is_section")).alias("section_delimited"),
    ]


def format_scores(lines: DataFrame) -> DataFrame:
    """A column for each fingerprint format: the share of sampled lines that look like it."""
    return _asked(_headed(lines, (",",))).groupBy("file_id").agg(*_score_columns())


def structural_class(fmt: Column, confidence: Column | None = None) -> Column:
    pairs = fmt == "key_value"
    sure = pairs & (confidence >= 0.6) if confidence is not None else F.lit(False)
    return F.when(fmt.isin(*STRUCTURED) | sure, "structured").when(fmt.isin(*SEMI_STRUCTURED), "semi_structured").otherwise("unstructured")


def normalize_class(c: Column) -> Column:
    """A class's name as others write it; unknown ones are unstructured."""
    name = F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")
    return F.when(name.isin("structured", "semi_structured", "unstructured"), name).otherwise("unstructured")


def measures(lines: DataFrame) -> DataFrame:
    """All that classification asks of the first 100 lines, in one pass and one shuffle.

    The fingerprint's columns, and s_* scores of the service over the first 50.
    """
    w = Window.partitionBy("file_id").orderBy("line_no")
    top = lines.withColumn("nth", F.row_number().over(w)).where("nth <= 100").where(F.trim(F.regexp_replace("line", r"\s", " ")) != "")
    s = _asked(_headed(top.withColumn("pos", F.row_number().over(w)), _CSV_MARKS, "line_no"))
    c, half = F.col("line"), F.col("nth") <= 50
    among = lambda hit: F.avg(F.when(half, F.when(hit, 1.0).otherwise(0.0)))
    clf, logfmt = among(F.col("is_access")), among(F.col("is_logfmt"))
    nginx = F.coalesce(F.max(F.when(half, F.lower(c).rlike("upstream|nginx"))), F.lit(False))
    service = {
        "json_lines": among(F.col("is_json") & S.is_json(c)),
        "csv": F.greatest(*[_csv_share(k, half) for k in range(len(_CSV_MARKS))]),
        "syslog": among(F.col("is_syslog")),
        "nginx_access": F.when(nginx, clf).otherwise(0.0),
        "apache_access": F.when(~nginx, clf).otherwise(0.0),
        "logfmt": logfmt,
        "key_value": F.when(logfmt == 0, among(F.col("is_pairs")) * 0.8).otherwise(0.0),
    }
    return s.groupBy("file_id").agg(*_score_columns(), *_stat_columns(), _heads(), *[v.alias(f"s_{k}") for k, v in service.items()])


def _fingerprinted(measured: DataFrame) -> DataFrame:
    d = measured.withColumn("best", _best({f: F.col(f) for f in FINGERPRINT_FORMATS}))
    d = d.withColumn("format_name", F.coalesce("best.format", F.lit("plain_text"))).withColumn("confidence", F.bround(F.coalesce("best.score", F.lit(0.5)), 3))
    return d.withColumn("fingerprint", _hash_of_heads()).withColumn("structural_class", structural_class(F.col("format_name"))).drop("best", "told")


def fingerprints(lines: DataFrame) -> DataFrame:
    """One row for each file: fingerprint, format, confidence, class, line statistics."""
    d = _fingerprinted(measures(lines))
    return d.select("file_id", "format_name", "confidence", "sample_lines", "avg_line_length", "line_length_std", "has_timestamps", "has_log_levels", "fingerprint", "structural_class")


def similarity(a: str, b: str) -> Column:
    """How alike two fingerprints are, 0 to 1."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    same = lambda c, w: F.when(x(c) == y(c), w).otherwise(0.0)
    longer = F.greatest(x("avg_line_length"), y("avg_line_length"), F.lit(1.0))
    return same("format_name", 0.4) + same("structural_class", 0.2) + same("has_timestamps", 0.1) + same("has_log_levels", 0.1) + 0.2 * F.least(x("avg_line_length"), y("avg_line_length")) / longer


#: What two fingerprints are compared by, besides their line lengths.
_TRAITS = ("format_name", "structural_class", "has_timestamps", "has_log_levels")


def _two_of_each_length(known: DataFrame) -> DataFrame:
    """Traits, length, near: the two greatest fingerprints of each traits and length and of its neighbours in length.

    Two are enough to have one that isn't the query's own. There is a row for
    each distinct length, however many files share it.
    """
    columns = [*_TRAITS, "avg_line_length"]
    one = known.groupBy("fingerprint").agg(F.min(F.struct(*columns)).alias("x")).select("fingerprint", "x.*")
    nth = F.row_number().over(Window.partitionBy(*columns).orderBy(F.desc("fingerprint")))
    two = one.withColumn("nth", nth).where("nth <= 2").groupBy(*columns).agg(F.collect_list("fingerprint").alias("prints"))
    w = Window.partitionBy(*_TRAITS).orderBy("avg_line_length")
    own = F.struct("avg_line_length", "prints")
    return two.select(*columns, F.array_compact(F.array(F.lag(own).over(w), own, F.lead(own).over(w))).alias("near"))


def similar_formats(queries: DataFrame, known: DataFrame, threshold: float = 0.8) -> DataFrame:
    """For each query fingerprint the most similar other known one: fingerprint, similar, score.

    Among known ones of equal traits the score falls with the distance in line
    length, so that only the neighbours in order of length are compared: with
    each distinct (traits, length) of the queries, in each set of traits that
    can still reach the threshold.
    """
    same = known is queries
    queries = written(queries.select("fingerprint", *_TRAITS, "avg_line_length"))
    k = written(_two_of_each_length(queries if same else known))
    of = lambda prefix: [F.col(c).alias(f"{prefix}{c}") for c in _TRAITS]
    # some ten formats with three classes and two flags: few rows on both sides
    mine, theirs = queries.select(*of("q_")).distinct(), k.select(*_TRAITS).distinct()
    weights = (0.4, 0.2, 0.1, 0.1)
    fixed = sum((F.when(F.col(f"q_{c}") == F.col(c), w).otherwise(0.0) for c, w in zip(_TRAITS, weights)), F.lit(0.2))
    met = mine.join(theirs, fixed >= threshold - 1e-9)
    asked = queries.select(*of("q_"), "avg_line_length").distinct().join(met, [f"q_{c}" for c in _TRAITS])
    lengths = asked.select(*_TRAITS, "avg_line_length").distinct()
    both = k.unionByName(lengths, allowMissingColumns=True)
    upto = lambda order: F.last("near", ignorenulls=True).over(Window.partitionBy(*_TRAITS).orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = F.array_union(F.coalesce(upto(F.asc("avg_line_length")), F.array()), F.coalesce(upto(F.desc("avg_line_length")), F.array()))
    near = both.select("*", near.alias("around")).where("near is null").select(*_TRAITS, "avg_line_length", "around")
    found = asked.join(near, [*_TRAITS, "avg_line_length"]).select(*[f"q_{c}" for c in _TRAITS], F.col("avg_line_length").alias("q_avg_line_length"), *_TRAITS, F.inline("around").alias("avg_line_length", "prints"))
    found = found.select("*", F.explode("prints").alias("similar")).drop("prints")
    told = [*_TRAITS, "avg_line_length"]
    found = found.select(*[F.col(f"q_{c}").alias(c) for c in told], F.struct(*told).alias("b"), "similar")
    d = queries.alias("a").join(found, told).where("a.fingerprint != similar").select("a.fingerprint", "similar", similarity("a", "b").alias("score"))
    return d.where(F.col("score") >= threshold).groupBy("fingerprint").agg(F.max(F.struct("score", "similar")).alias("m")).select("fingerprint", F.col("m.similar").alias("similar"), F.bround("m.score", 6).alias("score"))


def format_distribution(prints: DataFrame) -> DataFrame:
    return prints.groupBy("format_name").agg(F.count("*").alias("n_files"))


def _segmentation(n: Column, r: Column) -> tuple[Column, Column]:
    xml, short, many = F.col("detected_format") == "xml", (n <= 3) & F.col("detected_format").isin("plain_text", "unknown"), r > 0.15
    strategy = F.when(xml | short, "per_file").when(many, "per_multiline_cluster").otherwise("per_line")
    return strategy, F.when(xml, 0.9).when(short, 0.7).when(many, F.bround(F.least(0.6 + r, F.lit(0.95)), 2)).otherwise(0.9)


def segmentation(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """How a file is cut into records: per_file, per_multiline_cluster or per_line, with a confidence."""
    d = lines.groupBy("file_id").agg(F.count("*").alias("n"), _share(F.col("line").rlike(P.CONTINUATION)).alias("r")).join(formats, "file_id")
    strategy, confidence = _segmentation(F.col("n"), F.col("r"))
    return d.select("file_id", strategy.alias("strategy"), confidence.alias("confidence"))


def classify(files: DataFrame, lines: DataFrame, cache: DataFrame | None = None, threshold: float = 0.85) -> DataFrame:
    """One row for each file: detected_format, format_confidence, structural_class, parser_key, line_count, segmentation, warnings.

    A fingerprint of confidence .85 decides; else the service's scores do, with
    whole-document tests for JSON and XML. A known fingerprint of the cache
    (fingerprint, detected_format, format_confidence) with a confidence of at
    least threshold goes before both.
    """
    text = F.trim(F.regexp_replace("content", r"^\s+|\s+$", ""))
    # only what begins as XML goes to Python
    tag, text = F.startswith("text", F.lit("<")), files.select("file_id", "filename", text.alias("text"))
    whole = text.select("file_id", "filename", (F.col("text").rlike(r"^[\[{]") & S.is_json(F.col("text"))).alias("is_json"), (tag & _well_formed(F.when(tag, F.col("text")))).alias("is_xml"))
    continued = _share(F.col("line").rlike(P.CONTINUATION))
    counts = lines.groupBy("file_id").agg(F.count("*").alias("line_count"), continued.alias("continued"))
    d = whole.join(counts, "file_id", "left").join(_fingerprinted(measures(lines)), "file_id", "left")
    service = _best({"json_lines": F.greatest(F.when(F.col("is_json"), 0.98).otherwise(0.0), F.col("s_json_lines")), "xml": F.when(F.col("is_xml"), 0.95).otherwise(0.0), **{f: F.col(f"s_{f}") for f in SERVICE_FORMATS[2:]}})
    mapped = F.coalesce(*[F.when(F.col("format_name") == k, F.lit(v)) for k, v in FINGERPRINT_TO_FORMAT.items()])
    sure = F.col("confidence") >= 0.85
    d = d.withColumn("service", service)
    nothing = F.col("sample_lines").isNull()
    fmt = F.when(nothing, "unknown").when(sure, mapped).otherwise(F.coalesce("service.format", F.when(F.col("format_name") == "hex_dump", "hex_dump"), F.lit("plain_text")))
    conf = F.when(nothing, 0.0).when(sure, F.col("confidence")).otherwise(F.coalesce("service.score", F.lit(0.3)))
    d = d.withColumn("detected_format", fmt).withColumn("format_confidence", F.bround(F.least(conf, F.lit(1.0)), 2))
    if cache is not None:
        # of several entries the surest decides, of equals always the same
        best = F.max_by(F.struct(F.col("detected_format").alias("k_format"), F.col("format_confidence").alias("k_conf")), F.struct("format_confidence", F.col("detected_format") == "plain_text", F.hash("detected_format")))
        known = cache.where(F.col("format_confidence") >= threshold).groupBy("fingerprint").agg(best.alias("k")).select("fingerprint", "k.*")
        d = d.join(known, "fingerprint", "left").withColumn("detected_format", F.coalesce("k_format", "detected_format")).withColumn("format_confidence", F.coalesce("k_conf", "format_confidence"))
    extension = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    by_name = F.coalesce(*[F.when(extension == k, F.lit(v)) for k, v in EXTENSIONS.items()])
    parser = F.coalesce(*[F.when(F.col("detected_format") == k, F.lit(v)) for k, v in PARSERS.items()], by_name, F.lit("unified"))
    low_conf = F.when(F.col("line_count").isNull(), F.array(F.lit("File is empty."))).when(F.col("format_confidence") < 0.5, F.array(F.concat(F.lit("Low format confidence ("), F.format_number("format_confidence", 2), F.lit(") results may be approximate.")))).otherwise(F.array().cast("array<string>"))
    d = d.withColumn("structural_class", structural_class(F.col("detected_format"), F.col("format_confidence"))).withColumn("parser_key", parser).withColumn("warnings", low_conf)
    strategy, _ = _segmentation(F.col("line_count"), F.col("continued"))
    return d.select("file_id", "filename", "fingerprint", "detected_format", "format_confidence", "structural_class", "parser_key", F.coalesce("line_count", F.lit(0)).alias("line_count"), strategy.alias("segmentation"), "warnings")


@F.pandas_udf(BooleanType())
def _well_formed(texts: pd.Series) -> pd.Series:  # XML has no well-formedness test in the JVM
    import xml.etree.ElementTree as ET

    def ok(t) -> bool:
        if not isinstance(t, str) or not t.startswith("<") or "<!ENTITY" in t:
            return False
        try:
            ET.fromstring(t)
            return True
        except (ET.ParseError, ValueError):
            return False

    return texts.map(ok)


def overall(classified: DataFrame) -> DataFrame:
    """The verdict over all files: dominant format and class (the first file's among equals), confidence, warnings."""
    d = classified.where("line_count > 0")
    by = lambda c: d.groupBy(c).agg(F.count("*").alias("n"), F.min("file_id").alias("first")).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", c))[c].alias(c))
    base = F.avg("format_confidence") - F.least(0.05 * F.sum(F.size("warnings")), F.lit(0.2))
    total = d.agg(F.bround(F.greatest(F.lit(0.0), F.least(F.coalesce(base, F.lit(0.0)), F.lit(1.0))), 2).alias("confidence"), F.count("*").alias("n_files"), F.sum(F.size("warnings")).alias("n_warnings"))
    return by("detected_format").withColumnRenamed("detected_format", "dominant_format").join(by("structural_class")).join(total)


def _content_scores(lines: DataFrame) -> DataFrame:
    """file_id, all: an array of (score, rank, parser_key), what each parser finds of its own in a file's first 25 lines."""
    s = _headed(sample(lines, 25), _CSV_MARKS)
    c = F.col("line")
    clf = _share(c.rlike(P.ACCESS))
    nginx = _share(c.rlike(P.ACCESS) & F.lower(c).rlike("nginx|upstream"))
    dumps = F.count_if(c.rlike(P.HEX_DUMP))
    pairs = lambda p: _share(F.regexp_count(c, F.lit(p)) >= 2)
    scores = {
        "json_lines": _share(F.trim(c).rlike(r"^\{[\s\S]*\}$")),
        "csv": F.when(dumps >= 3, 0.0).otherwise(F.greatest(*[_csv_share(k) for k in range(len(_CSV_MARKS))])),
        "xml": F.max(F.when((F.col("pos") == 1) & F.trim(c).rlike(r"^<[A-Za-z?!_]"), 0.95).otherwise(0.0)),
        "syslog": _share(c.rlike(P.SYSLOG)),
        "apache_access": clf,
        "nginx_access": F.when(nginx > 0, nginx).otherwise(clf),
        "logfmt": pairs(P.LOGFMT_PAIR),
        "key_value": pairs(P.KEY_VALUE_PAIR),
        "binary_hex": F.when(dumps >= 3, 1.0).when(F.avg(F.regexp_count(c, F.lit(r"\b[0-9a-fA-F]{2}\b"))) >= 8, 0.85).otherwise(0.0),
    }
    return s.groupBy("file_id").agg(F.array(*[F.struct(v.alias("score"), F.lit(-k).alias("rank"), F.lit(n).alias("parser_key")) for k, (n, v) in enumerate(scores.items())]).alias("all"))


def parser_support(lines: DataFrame) -> DataFrame:
    """file_id, parser_key, score for each parser that has a claim on a file's first 25 lines, the best first by rank."""
    best = F.filter(F.sort_array("all", asc=False), lambda x: x["score"] > 0)
    return _content_scores(lines).select("file_id", F.posexplode(best).alias("rank", "x")).select("file_id", "rank", "x.parser_key", F.bround("x.score", 2).alias("score"))


# The extensions that a parser takes as its own, what such a name is worth, and the least share of content without it.
OWN_EXTENSIONS = {"json_lines": ("json", "jsonl", "ndjson"), "csv": ("csv", "tsv"), "xml": ("xml",), "syslog": ("syslog", "log"), "binary_hex": ("bin", "hex", "dump")}
NAME_SCORE, CONTENT_SCORE = 0.95, 0.6


def discovered(files: DataFrame, lines: DataFrame) -> DataFrame:
    """file_id, parser_key, supported, score, rank: every parser's claim on a file by its name and its content, the best first.

    The unified parser takes anything, the surer the fingerprint is, and goes
    before others of equal score. An empty file is claimed by its name alone.
    """
    name = F.lower(F.regexp_extract("filename", r"\.([^.]*)$", 1))
    sure = _fingerprinted(measures(lines)).select("file_id", F.col("confidence").alias("sure"))
    d = files.select("file_id", "filename").join(_content_scores(lines), "file_id", "left").join(sure, "file_id", "left")
    none = F.array(*[F.struct(F.lit(0.0).alias("score"), F.lit(-k).alias("rank"), F.lit(n).alias("parser_key")) for k, n in enumerate(PARSER_KEYS)])
    own = F.coalesce(*[F.when(name.isin(*x), F.lit(k)) for k, x in OWN_EXTENSIONS.items()], F.lit(""))

    def claim(x: Column) -> Column:
        named = x["parser_key"] == F.col("own")
        dump = named & (x["parser_key"] == "binary_hex") & (x["score"] > 0)
        score = F.when(dump, F.least(x["score"], F.lit(1.0))).when(named, NAME_SCORE).otherwise(F.bround(x["score"], 2))
        return F.struct((named | (x["score"] >= CONTENT_SCORE)).alias("supported"), score.alias("score"), (x["rank"] - 1).alias("order"), x["parser_key"].alias("parser_key"))

    whole = F.when(F.col("sure").isNull(), 0.4).when(files_of.is_binary_name(F.col("filename")), NAME_SCORE).otherwise(F.bround(F.greatest(F.lit(0.75), F.least(F.lit(0.99), 0.6 + 0.4 * F.col("sure"))), 2))
    unified = F.struct(F.lit(True).alias("supported"), whole.alias("score"), F.lit(0).alias("order"), F.lit("unified").alias("parser_key"))
    claims = F.concat(F.array(unified), F.transform(F.coalesce("all", none), claim))
    d = d.withColumn("own", own).select("file_id", F.posexplode(F.sort_array(claims, asc=False)).alias("rank", "x"))
    return d.select("file_id", "x.parser_key", "x.supported", "x.score", "rank")


def unified_format(lines: DataFrame, formats: DataFrame) -> DataFrame:
    """file_id, format: how the unified parser reads a file, from its name, its first lines and what was detected
    (file_id, filename, detected_format)."""
    c = F.trim("line")
    s = sample(lines, 30)
    ten = F.col("pos") <= 10
    g = s.groupBy("file_id").agg(
        ((F.count_if(ten & F.contains(c, F.lit(","))) >= 3) & (F.count_if(ten & F.contains(c, F.lit("{"))) == 0)).alias("commas"),
        F.bool_and(~ten | c.rlike(r"^\{.*\}$")).alias("objects"),
        F.bool_or(ten & c.rlike(r"^<.*>$")).alias("tags"),
        (F.count_if((F.col("pos") <= 20) & c.rlike(r"^<[\s\S]*(?:Mar|Jan) ")) >= 3).alias("dated"),
    )
    name = F.lower("filename")
    seen = F.col("detected_format")
    fmt = F.when(name.endswith(".json"), "json_lines").when(name.endswith(".csv"), "csv").when(name.endswith(".xml"), "xml").when(F.col("commas"), "csv").when(F.col("objects"), "json_lines").when(F.col("tags"), "xml").when(F.contains(seen, F.lit("syslog")), "syslog").when((seen == "plain_text") & F.col("dated"), "syslog").otherwise(seen)
    return formats.join(g, "file_id", "left").select("file_id", fmt.alias("format"))


def reclassify(classified: DataFrame, lines: DataFrame, ask, threshold: float = 0.7) -> DataFrame:
    """The verdicts, those below threshold replaced by ask(filename, first lines) where it names a known format.

    ask runs in tasks, once for each unsure file.
    """
    unsure = classified.where(F.col("format_confidence") < threshold).select("file_id", "filename")
    told = sample(lines, 50).join(unsure.select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("told"))
    heads = unsure.join(told, "file_id").select("file_id", "filename", F.array_join(F.transform("told", lambda x: x["line"]), "\n").alias("head"))

    def answer(frames):
        for frame in frames:
            yield pd.DataFrame({"file_id": frame.file_id, "asked": [ask(n, h) for n, h in zip(frame.filename, frame["head"])]})

    said = heads.mapInPandas(answer, "file_id string, asked string").where(F.col("asked").isin(*PARSERS, "plain_text"))
    parser = F.coalesce(*[F.when(F.col("asked") == k, F.lit(v)) for k, v in PARSERS.items()], F.when(F.col("asked").isNotNull(), "unified"), F.col("parser_key"))
    d = classified.join(said, "file_id", "left").withColumn("parser_key", parser)
    return d.withColumn("detected_format", F.coalesce("asked", "detected_format")).withColumn("structural_class", structural_class(F.col("detected_format"), F.col("format_confidence"))).drop("asked")
