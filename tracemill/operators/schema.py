"""Schemas inferred from records, typed tables, relationships between tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import scalars as S
from ..sources.lines import sample
from ..sources.shared import written


@dataclass(frozen=True)
class Column:
    name: str
    sql_type: str
    nullable: bool = True
    description: str = ""
    primary_key: bool = False


@dataclass(frozen=True)
class Relationship:
    parent: str
    child: str
    keys: tuple[str, ...]


# Columns that parsed text carries besides its own.
BASELINE = (Column("id", "BIGINT", False, "Row number.", True), Column("timestamp", "TEXT", True, "When the event happened."), Column("raw", "TEXT", True, "The line as it was."), Column("extra", "JSON", True, "Fields without a column."))
TRACEABILITY = (Column("source", "TEXT", True, "Source filename."), Column("message", "TEXT", True, "Primary message text."), Column("log_level", "TEXT", True, "Detected log level."))


_ROWS = "\x00rows"


def infer(records: DataFrame, map_column: str = "fields", by: tuple[str, ...] = ("logical_name",)) -> DataFrame:
    """One row for each table and key: sql_type, n_present, n_null, nullable.

    The widest type over all values wins (TEXT, JSON, REAL, INTEGER, BOOLEAN),
    and a null that is written out makes a column TEXT. One shuffle, whatever
    the number of keys.
    """
    # a key that no record has counts the records themselves
    entries = F.concat(F.map_entries(map_column), F.array(F.struct(F.lit(_ROWS).alias("key"), F.lit("").alias("value"))))
    each = records.select(*by, F.inline(entries).alias("name", "value"))
    g = each.withColumn("kind", S.value_kind(F.col("value"))).groupBy(*by, "name").agg(F.max(S.type_rank(F.col("kind"))).alias("rank"), F.count("*").alias("n_present"), F.count_if(F.col("kind") == "null").alias("n_null"))
    g = g.withColumn("n_rows", F.max(F.when(F.col("name") == _ROWS, F.col("n_present"))).over(Window.partitionBy(*by))).where(F.col("name") != _ROWS)
    return g.select(*by, "name", S.sql_type(F.col("rank")).alias("sql_type"), "n_present", "n_null", ((F.col("n_present") < F.col("n_rows")) | (F.col("n_null") > 0)).alias("nullable"))


def columns_of(inferred: DataFrame) -> dict[str, list[Column]]:
    """The inferred columns of each logical table, by name: a row for each column of the catalog comes to the driver."""
    out: dict[str, list[Column]] = {}
    for r in inferred.orderBy("logical_name", "name").collect():
        out.setdefault(r.logical_name, []).append(Column(r.name, r.sql_type, r.nullable))
    return out


def normalized(records: DataFrame, map_column: str = "fields", as_is: tuple[str, ...] = ("source_file",)) -> DataFrame:
    """Records with every value but those as_is in its normal text, once for all columns that are made of them."""
    return records.withColumn(map_column, F.transform_values(map_column, lambda k, v: F.when(k.isin(*as_is), v).otherwise(S.coerce(v)["value"])))


def typed(records: DataFrame, columns: list[Column], map_column: str = "fields") -> DataFrame:
    """Normalized records as a table: file_id, row_no and the columns with their Spark types. A column named id becomes id_value."""
    out = []
    for c in columns:
        value = F.col(map_column)[c.name]
        if c.sql_type in ("INTEGER", "REAL"):  # booleans among numbers are 0 and 1
            value = F.when(value == "true", "1").when(value == "false", "0").otherwise(value)
        out.append(value.try_cast(S.SPARK_TYPE[S.STORE_TYPE[c.sql_type]]).alias("id_value" if c.name == "id" else c.name))
    keys = [k for k in ("file_id", "row_no") if k in records.columns and k not in {c.name for c in columns}]
    return records.select(*keys, *out)


def ddl(table: str, columns: list[Column]) -> str:
    """CREATE TABLE text with quoted names."""
    kinds = {"BOOLEAN": "BOOLEAN", "INTEGER": "BIGINT", "BIGINT": "BIGINT", "REAL": "DOUBLE", "JSON": "STRING", "TEXT": "STRING"}
    body = ",\n".join(f"  `{c.name}` {kinds[c.sql_type]}" + ("" if c.nullable else " NOT NULL") + (f" COMMENT '{c.description}'" if c.description else "") for c in columns)
    return f"CREATE TABLE `{table}` (\n{body}\n)"


# Which tables of a recipe belong together, on all of their keys.
RECIPE_RELATIONSHIPS = (Relationship("recipe", "recipe_steps", ("recipe_id",)), Relationship("recipe_steps", "recipe_setpoints", ("recipe_id", "step_seq")), Relationship("recipe_steps", "recipe_interlocks", ("recipe_id", "step_seq")), Relationship("recipe_steps", "recipe_tolerances", ("recipe_id", "step_seq")))


def relationships(tables: list[str]) -> list[Relationship]:
    """How the tables of one document are linked."""
    if "recipe" in tables:
        return [r for r in RECIPE_RELATIONSHIPS if r.child in tables]
    root = "run" if "run" in tables else tables[0] if tables else ""
    return [Relationship(root, t, ("document_id",)) for t in tables if t != root]


def join_child(tables: dict[str, DataFrame], r: Relationship, how: str = "inner") -> DataFrame:
    """Parent rows with their children; the child's other columns that clash get its name before them."""
    parent, child = tables[r.parent], tables[r.child]
    for c in child.columns:
        if c in parent.columns and c not in r.keys:
            child = child.withColumnRenamed(c, f"{r.child}_{c}")
    return parent.join(child, list(r.keys), how)


def fallback_columns(lines: DataFrame) -> DataFrame:
    """file_id, columns: the schema of free text by hints in its first lines."""
    low = F.lower("line")
    g = lines.where("line_no <= 20").groupBy("file_id").agg(F.max(F.contains(low, F.lit("timestamp")) | F.col("line").rlike(r"\d{4}-\d{2}-\d{2}")).alias("ts"), F.max(F.contains(low, F.lit("error")) | F.contains(low, F.lit("exception"))).alias("err"))
    return g.select("file_id", F.concat(F.array(F.lit("message"), F.lit("log_level"), F.lit("source")), F.when(F.col("ts"), F.array(F.lit("timestamp"))).otherwise(F.array().cast("array<string>")), F.when(F.col("err"), F.array(F.lit("error_code"))).otherwise(F.array().cast("array<string>"))).alias("columns"))


def estimated_null_rate(lines: DataFrame, names: list[str]) -> DataFrame:
    """file_id, name, null_rate: the share of lines that show no value for a column's name (as name: or name=, _ as space too)."""
    hint = lambda n: F.lower("line").rlike(r"\b(?:" + "|".join({_escaped(n), _escaped(n.replace("_", " "))}) + r")\s*[:=]")
    direct = {"message": F.lit(True), "raw": F.lit(True), "source": F.lit(True), "timestamp": F.col("line").rlike(P.ANY_TIMESTAMP), "log_level": F.col("line").rlike(P.LEVEL_WORD)}
    g = lines.where(F.trim("line") != "").groupBy("file_id").agg(*[F.bround(1 - F.avg((direct[n] if n in direct else hint(n)).cast("double")), 3).alias(n) for n in names])
    return g.select("file_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*[F.col(f"`{n}`") for n in names]))).alias("name", "null_rate"))


def _escaped(name: str) -> str:
    return "".join(c if c.isalnum() or c in "_ " else "\\" + c for c in name.lower())


#: Rounds of refining, the null rate from which a column is asked about again, the lines that rates are taken from, the lines shown.
ROUNDS, HIGH_NULL, RATED_LINES, SHOWN_LINES = 3, 0.6, 100, 50
#: propose(lines, columns so far, their high null rates) gives columns, or None where it can't.
Propose = Callable[[list[str], list[Column], dict[str, float]], list[Column] | None]


@dataclass
class Refined:
    """The columns at the end, and the null rates that each round of columns had."""

    columns: list[Column]
    rates: list[dict[str, float]]
    warnings: list[str]


def refined(lines: DataFrame, propose: Propose, rounds: int = ROUNDS) -> Refined:
    """Columns for free text that propose names, asked again while a column's estimated null rate is high, some rounds at most.

    Rates are one aggregation over the first RATED_LINES non-blank lines of each
    file for each round; at most SHOWN_LINES of them come to the driver. Where
    nothing is proposed at first, the columns are those of the text's hints.
    """
    head = written(sample(lines, RATED_LINES).select(F.lit("").alias("file_id"), F.col("file_id").alias("of"), "line_no", "line"))
    shown = [r.line for r in head.orderBy("of", "line_no").limit(SHOWN_LINES).collect()]
    columns, rates, warnings = propose(shown, [], {}), [], []
    if not columns:
        warnings.append("No schema was proposed; columns are told by hints.")
        hints = fallback_columns(head).first()
        columns = [Column(n, "TEXT") for n in (hints.columns if hints else ["message", "log_level", "source"])]
    for k in range(rounds + 1):
        found = estimated_null_rate(head, [c.name for c in columns]).collect()
        rates.append({r.name: r.null_rate for r in found})
        high = {n: r for n, r in rates[-1].items() if r >= HIGH_NULL}
        if not high or k == rounds or warnings:
            break
        better = propose(shown, columns, high)
        if not better:
            warnings.append("Schema refinement failed: nothing was proposed.")
            break
        columns = better
    return Refined(columns, rates, warnings)
