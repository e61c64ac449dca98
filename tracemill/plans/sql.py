"""Read-only SQL on named tables, and ready-made questions.

Spark parses the text; the guard looks at the parsed plan, not at the words.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import QUERY_ROWS
from . import dialect as dialects

# Functions that reach outside of the data.
FORBIDDEN_FUNCTIONS = ("reflect", "java_method", "try_reflect", "input_file_name", "version", "current_user", "session_user", "user")
#: Nodes of parsed plans that only read; whatever else a text parses to is refused.
READS = frozenset("Project Filter Aggregate Join LateralJoin Sort GlobalLimit LocalLimit LimitAll Tail Offset Distinct Union Intersect Except SubqueryAlias UnresolvedRelation UnresolvedWith CTE UnresolvedHaving UnresolvedInlineTable InlineTable LocalRelation OneRowRelation Window WithWindowDefinition UnresolvedSubqueryColumnAliases Pivot Unpivot Generate Sample RepartitionByExpression UnresolvedHint Subquery".split())


class NotAllowed(ValueError):
    """The text is no single read-only query of the allowed tables."""


@dataclass
class Result:
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    row_count: int = 0
    elapsed_ms: float = 0.0
    error: str | None = None


@contextmanager
def _double_quotes(spark: SparkSession) -> Iterator[None]:
    """Double quotes name columns here, and only while a text is parsed."""
    before = spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers")
    spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", before)


def dialect(text: str) -> str:
    """Type names that other databases write, as Spark knows them, outside of quotes."""
    parts = re.split(r"('(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`)", text.strip().rstrip(";"))
    for k in range(0, len(parts), 2):
        parts[k] = re.sub(r"(?i)\bAS\s+TEXT\b", "AS STRING", parts[k])
        parts[k] = re.sub(r"(?i)\bAS\s+REAL\b", "AS DOUBLE", parts[k])
        parts[k] = re.sub(r"(?i)\b(information_schema)\.(columns|tables)\b", r"\1_\2", parts[k])
    return "".join(parts)


def check(spark: SparkSession, text: str, allowed: set[str]) -> str:
    """The text as Spark runs it, or NotAllowed."""
    if not text.strip():
        raise NotAllowed("Query is empty.")
    sql = dialects.distinct_on(dialect(text))
    try:
        with _double_quotes(spark):
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise NotAllowed(f"Not a query: {str(e).splitlines()[0]}") from None
    tree = plan.toString()
    kinds = [m[1] for m in re.finditer(r"(?m)^[\s:+|-]*'?(\w+)", tree)]
    if bad := [k for k in kinds if k not in READS]:
        raise NotAllowed(f"Only SELECT statements are allowed, not {bad[0]}.")
    low = {m.lower() for m in re.findall(r"'(\w+)\(", tree)} | {m.lower() for m in re.findall(r"(?<![\w.`\"'])(\w+)\s*\(", re.sub(r"'(?:[^']|'')*'", "''", sql))}
    if bad := low & set(FORBIDDEN_FUNCTIONS):
        raise NotAllowed(f"Function not allowed: {sorted(bad)[0]}.")
    own = {m.lower() for m in re.findall(r"(?i)(?:\bWITH\s+(?:RECURSIVE\s+)?|,\s*)[`\"]?(\w+)[`\"]?\s*(?:\([^()]*\)\s*)?AS\s*\(", re.sub(r"'(?:[^']|'')*'", "''", sql))}
    for name in re.findall(r"UnresolvedRelation \[([^\]]*)\]", tree):
        parts = [p.strip() for p in name.split(",")]
        if len(parts) != 1 or parts[0].lower() not in {t.lower() for t in allowed} | own:
            raise NotAllowed(f"Table not allowed: {'.'.join(parts)}.")
    with _double_quotes(spark):
        return dialects.whole_division(spark, dialects.nulls_last(spark, sql))


def query(spark: SparkSession, text: str, allowed: set[str]) -> DataFrame:
    """The guarded query as a DataFrame."""
    sql = check(spark, text, allowed)
    with _double_quotes(spark):
        return spark.sql(sql)


def run(spark: SparkSession, text: str, allowed: set[str], limit: int = QUERY_ROWS) -> Result:
    """At most limit rows (what a screen shows), the full row count, the time; errors are told, not raised."""
    began = time.perf_counter()
    try:
        df = query(spark, text, allowed)
        rows = [r.asDict(recursive=True) for r in serialized(df).limit(limit + 1).collect()]
        n = len(rows) if len(rows) <= limit else df.count()
        return Result(df.columns, rows[:limit], n, (time.perf_counter() - began) * 1000)
    except NotAllowed as e:
        return Result(error=str(e), elapsed_ms=(time.perf_counter() - began) * 1000)
    except Exception as e:  # what a query does wrong is an answer too
        return Result(error=str(e).splitlines()[0], elapsed_ms=(time.perf_counter() - began) * 1000)


def serialized(df: DataFrame) -> DataFrame:
    """Nested values as JSON, times in ISO form."""
    out = []
    for c, kind in df.dtypes:
        q = F.col(f"`{c}`")
        if kind.startswith(("array", "map", "struct")):
            q = F.to_json(q)
        elif kind.startswith("timestamp"):
            q = F.date_format(q, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out.append(q.alias(c))
    return df.select(*out)


def ask(spark: SparkSession, question: str, allowed: set[str], to_sql: Callable[[str, str], str]) -> Result:
    """A question in words: to_sql(question, schema) writes the query, which passes the same guard."""
    schema = "\n".join(f"{t}({', '.join(f'{c} {k}' for c, k in spark.table(t).dtypes)})" for t in sorted(allowed))
    text = re.sub(r"^\s*```(?:sql)?\s*|\s*```\s*$", "", to_sql(question, schema))
    return run(spark, text, allowed)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


# The questions that need no writing.
def preview_rows(table: str, n: int = 10) -> str:
    return f"SELECT * FROM {_quoted(table)} LIMIT {int(n)}"


def row_count(table: str) -> str:
    return f"SELECT count(*) AS row_count FROM {_quoted(table)}"


def column_types(table: str) -> str:
    return f"SELECT column_name, data_type FROM information_schema_columns WHERE table_name = '{table.replace(chr(39), chr(39) * 2)}' ORDER BY ordinal_position"


def value_distribution(table: str, column: str, n: int = 20) -> str:
    return f"SELECT {_quoted(column)} AS value, count(*) AS n FROM {_quoted(table)} GROUP BY {_quoted(column)} ORDER BY n DESC, value LIMIT {int(n)}"


def time_range(table: str, column: str) -> str:
    return f"SELECT min({_quoted(column)}) AS first, max({_quoted(column)}) AS last FROM {_quoted(table)}"


def casted_averages(table: str, columns: list[str]) -> str:
    return "SELECT " + ", ".join(f"avg(try_cast({_quoted(c)} AS REAL)) AS {_quoted('avg_' + c)}" for c in columns) + f" FROM {_quoted(table)}"
