"""What people do with parsed tables: filter, page, count, export, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

QUERY_ROWS = 500
LEVEL_COLUMNS, TIME_COLUMNS = ("log_level", "level", "severity"), ("timestamp", "ts", "time")


def _like(c: Column, text: str) -> Column:
    return F.contains(F.lower(S.export_text(c)), F.lit(text.lower()))


def searched_text(df: DataFrame) -> Column:
    """What a search of df looks at: names and cells of a row as one text, in small letters."""
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return F.lower(S.export_text(row))


def search(df: DataFrame, text: str) -> DataFrame:
    """Rows in which any cell or name holds text, whatever its case; blank text keeps all."""
    if not text.strip():
        return df
    return df.where(F.contains(searched_text(df), F.lit(text.strip().lower())))


def with_levels(df: DataFrame, levels: list[str]) -> DataFrame:
    """Rows whose level is one of levels; WARNING and WARN are one."""
    have = [c for c in LEVEL_COLUMNS if c in df.columns]
    if not levels or not have:
        return df if not levels else df.limit(0)
    wanted = {"WARN" if x.strip().upper() == "WARNING" else x.strip().upper() for x in levels}
    return df.where(S.normalize_level(F.coalesce(*have)).isin(*wanted))


def with_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Rows in which each named column holds its text, whatever its case; a missing column is empty."""
    for name, text in fields.items():
        if text.strip():
            df = df.where(_like(F.col(f"`{name}`") if name in df.columns else F.lit(""), text.strip()))
    return df


def within(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows from start to end, both included; a bound that is no timestamp is none; with a bound, rows without time go."""
    at = S.row_timestamp(*[F.col(c) for c in TIME_COLUMNS if c in df.columns] or [F.lit(None)])
    low, high = S.as_timestamp(F.lit(start)), S.as_timestamp(F.lit(end))
    some = low.isNotNull() | high.isNotNull()
    return df.where(~some | (at.isNotNull() & F.coalesce(at >= low, F.lit(True)) & F.coalesce(at <= high, F.lit(True))))


def filtered(df: DataFrame, text: str = "", levels: list[str] = (), fields: dict[str, str] | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """All filters as one predicate on the scan."""
    return within(with_fields(with_levels(search(df, text), list(levels)), fields or {}), start, end)


def equal_to(df: DataFrame, values: dict[str, object], limit: int = 100, offset: int = 0) -> DataFrame:
    """Rows with these values, a page of them."""
    for name, v in values.items():
        df = df.where(F.col(f"`{name}`").eqNullSafe(F.lit(v)))
    return df.offset(offset).limit(limit)


def page(df: DataFrame, sort: str, descending: bool = False, size: int = 20, number: int = 0) -> DataFrame:
    """A page of the table in order; equal rows are ordered by their other columns."""
    order = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    return df.orderBy(order, *[c for c in df.columns if c != sort]).offset(size * number).limit(size)


def facets(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def visible_columns(df: DataFrame, null_ratio: dict[str, float]) -> list[str]:
    """Columns that are shown at first: none that only trace where a row came from, none that is all null."""
    hidden = {"id", "raw", "parse_confidence", "message"}
    return [c for c in df.columns if c not in hidden and not c.startswith("source") and not c.endswith("_id") and null_ratio.get(c, 0.0) < 1.0]


def _at_most(df: DataFrame, limit: int | None) -> DataFrame:
    return df if limit is None else df.limit(limit)


def export_rows(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Every cell as the text of an export; with a limit at most so many rows, whichever come first."""
    nested = {c for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))}
    return _at_most(df, limit).select(*[(F.coalesce(F.to_json(c), F.lit("")) if c in nested else S.export_text(F.col(f"`{c}`"))).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, limit: int | None = None) -> None:
    export_rows(df, limit).write.mode("overwrite").option("header", True).option("emptyValue", "").option("quoteAll", False).csv(path)


def write_json(df: DataFrame, path: str, limit: int | None = None) -> None:
    _at_most(df, limit).write.mode("overwrite").option("ignoreNullFields", False).json(path)


# -- summaries --------------------------------------------------------------------


def value_distribution(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def time_range(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("first"), F.max(column).alias("last"), F.count(column).alias("n"))


def casted_averages(df: DataFrame, columns: list[str]) -> DataFrame:
    """The mean of each column's numbers, text without one left out."""
    return df.agg(*[F.avg(F.col(f"`{c}`").cast("string").try_cast("double")).alias(c) for c in columns])


def chart(df: DataFrame, x: str, y: str) -> DataFrame:
    """Points of a chart: x as text, y as number."""
    return df.select(S.export_text(F.col(x)).alias("x"), S.chart_number(F.col(y)).alias("y"))


def status_counts(processes: DataFrame) -> DataFrame:
    return processes.groupBy("status").agg(F.count("*").alias("n"))


def batch_status(processes: DataFrame, key: str = "batch_id") -> DataFrame:
    """failed if no file of a batch was queued, queued if all were, else partial."""
    g = processes.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col("queued")).alias("q"))
    return g.select(key, F.when(F.col("q") == 0, "failed").when(F.col("q") == F.col("n"), "queued").otherwise("partial").alias("status"))


def latest_completed(processes: DataFrame, key: str = "file_id", order: str = "updated_at") -> DataFrame:
    """Of each key the completed row that was updated last."""
    rest = [c for c in processes.columns if c != key]
    best = F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order and dict(processes.dtypes)[c] in ("bigint", "int", "string")]))
    return processes.where(F.col("status") == "completed").groupBy(key).agg(best.alias("r")).select(key, "r.*")


def result_rows(processes: DataFrame, column: str = "result") -> DataFrame:
    """Adds row_count and parser_key told by a stored result: {"records": {table: [rows]}, "parser_key": ...}."""
    records = F.from_json(F.get_json_object(column, "$.records"), "map<string,string>")
    sizes = F.transform(F.map_values(records), lambda v: F.coalesce(F.json_array_length(v), F.lit(0)))
    n = F.coalesce(F.aggregate(sizes, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")
    key = F.coalesce(F.nullif(F.get_json_object(column, "$.parser_key"), F.lit("")), F.nullif(F.get_json_object(column, "$.classification.selected_parser_key"), F.lit("")))
    return processes.withColumn("row_count", n).withColumn("parser_key", key)


def parser_distribution(processes: DataFrame) -> DataFrame:
    return processes.where("parser_key is not null").groupBy("parser_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "parser_key")


def listing(df: DataFrame, owner: str, value: object, order: str = "created_at") -> DataFrame:
    """What an owner has, the latest first."""
    return df.where(F.col(owner) == F.lit(value)).orderBy(F.desc(order))


def orphans(assets: DataFrame, links: DataFrame, key: str = "asset_id") -> DataFrame:
    return assets.join(links, key, "left_anti")


def dashboard(groups: DataFrame, files: DataFrame, processes: DataFrame) -> DataFrame:
    """One row: groups, files, processes by status, rows of completed ones."""
    g, f = groups.agg(F.count("*").alias("n_groups")), files.agg(F.count("*").alias("n_files"))
    p = processes.join(groups, "group_id", "left_semi").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("queued", "processing", "completed", "failed")], F.coalesce(F.sum(F.when(F.col("status") == "completed", F.col("row_count"))), F.lit(0)).alias("total_rows"))
    return g.crossJoin(f).crossJoin(p)  # three single rows


def by_source(tables: DataFrame) -> DataFrame:
    """Tables (table_name, source, row_count) by source file: n_tables, n_rows."""
    return tables.groupBy("source").agg(F.count("*").alias("n_tables"), F.sum("row_count").alias("n_rows")).orderBy("source")


def numbered(warnings: DataFrame) -> DataFrame:
    """Equal warnings of a process told apart by a number from the second on."""
    w = Window.partitionBy("process_id", "warning").orderBy("at")
    n = F.row_number().over(w)
    return warnings.withColumn("label", F.when(n > 1, F.concat("warning", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("warning")))


def field_scores(gold: DataFrame, found: DataFrame) -> DataFrame:
    """precision, recall, f1 over the distinct (field, value) pairs of two record sets."""
    g, f = gold.select("field", S.export_text(F.col("value")).alias("value")).distinct(), found.select("field", S.export_text(F.col("value")).alias("value")).distinct()
    d = g.withColumn("g", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["field", "value"], "full").agg(F.count("g").alias("n_gold"), F.count("f").alias("n_found"), F.count_if(F.col("g").isNotNull() & F.col("f").isNotNull()).alias("n_both"))
    p, r = F.coalesce(F.try_divide("n_both", "n_found"), F.lit(0.0)), F.coalesce(F.try_divide("n_both", "n_gold"), F.lit(0.0))
    return d.select("n_gold", "n_found", "n_both", F.bround(p, 6).alias("precision"), F.bround(r, 6).alias("recall"), F.bround(F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)), 6).alias("f1"))


def report(name: str, tables: dict[str, DataFrame], findings: DataFrame, sample: int = 10) -> str:
    """A Markdown report: tables with row counts and first rows, findings by severity. Holds only samples."""
    out = [f"# {name}", ""]
    for title, df in tables.items():
        out += [f"## {title}", "", f"{df.count()} rows", "", "| " + " | ".join(df.columns) + " |", "|" + " - |" * len(df.columns)]
        out += ["| " + " | ".join(str(v).replace("|", "\\|") for v in row) + " |" for row in export_rows(df, sample).collect()] + [""]
    out += ["## Findings", ""] + [f"- {r.severity}: {r.n}" for r in findings.groupBy("severity").agg(F.count("*").alias("n")).orderBy("severity").collect()]
    return "\n".join(out)


def union_all(spark: SparkSession, frames: list[DataFrame]) -> DataFrame:
    """Tables of the same name from several parsers as one."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
