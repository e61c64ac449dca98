"""The gate that parsed tables pass: one aggregation for each table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NULL_THRESHOLD, DUPLICATE_THRESHOLD, HEADER_THRESHOLD = 0.3, 0.8, 0.7
TRACE_FIELDS = ("raw", "message", "source", "log_level", "timestamp")


@dataclass
class TableReport:
    table: str
    row_count: int
    column_null_ratios: dict[str, float]
    table_null_ratio: float
    penalty: float
    warnings: list[str] = field(default_factory=list)

    @property
    def failed(self) -> bool:
        return bool(self.warnings)


@dataclass(frozen=True)
class Rule:
    """When a table breaks it, by what was measured, what the gate says then, and what it costs."""

    broken: Callable[[dict[str, float]], bool]
    says: str
    costs: Callable[[dict[str, float]], float] = lambda told: 0.0


REQUIRED = Rule(lambda t: max(t["worst"], t["mean"]) > NULL_THRESHOLD, "Required fields exceeded null threshold (max={worst:.2f}, avg={mean:.2f}).", lambda t: min(0.7, t["mean"] + 0.2))
RULES = (
    Rule(lambda t: t["header"] >= HEADER_THRESHOLD, "Detected header row emitted as data."),
    Rule(lambda t: t["tag"] > 0, "Detected XML tag-only rows in structured output."),
    Rule(lambda t: t["declaration"] > 0, "Detected XML declaration-only rows in structured output."),
    Rule(lambda t: t["duplicate"] >= DUPLICATE_THRESHOLD, "Detected duplicated raw/message content ratio {duplicate:.2f} in structured output."),
    REQUIRED,
    Rule(lambda t: t["masked"] > NULL_THRESHOLD, "Structured columns are mostly null while traceability fields are populated (ratio={masked:.2f}).", lambda t: 0.6),
)


def null_ratios(table: DataFrame) -> DataFrame:
    """column, null_ratio for every column, in one pass."""
    ratios = table.agg(*[F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in table.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.bround(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)), 3).alias("null_ratio")) for c in table.columns])
    return ratios.select(F.inline(pairs))


def _all_null(columns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNull() for c in columns])


def evaluate(name: str, table: DataFrame, required: list[str], trace: tuple[str, ...] = (), order: str | None = None) -> TableReport:
    """The gate's verdict: header as data, stray XML, raw repeated as message, nulls in required columns, masking."""
    have = table.columns
    texts = [c for c, kind in table.dtypes if kind == "string"]
    known = [c for c in required if c in have]
    trim = lambda c: F.trim(F.col(f"`{c}`"))
    any_text = lambda p: F.coalesce(F.max(reduce(lambda a, b: a | b, [F.coalesce(trim(c).rlike(p), F.lit(False)) for c in texts])), F.lit(False)) if texts else F.lit(False)
    aggs = [F.count("*").alias("__n"), any_text(r"^</.*>$|^</?(?:step|recipe)>$").alias("__tag"), any_text(r"^<\?xml").alias("__decl")]
    if {"raw", "message"} <= set(texts):
        aggs.append(F.avg((trim("raw") == trim("message")).cast("double")).alias("__dup"))
    filled = [c for c in trace if c in have and c not in required]
    if known and filled:
        masked = _all_null(known) & reduce(lambda a, b: a | b, [F.coalesce(F.col(f"`{c}`").cast("string") != "", F.lit(False)) for c in filled])
        aggs.append(F.avg(masked.cast("double")).alias("__mask"))
    if known:
        first = F.struct(*[F.lower(F.trim(F.col(f"`{c}`").cast("string"))).alias(f"h{k}") for k, c in enumerate(known)])
        by = order or [c for c in ("file_id", "row_no") if c in have] or have  # of rows without an order the least
        by = F.col(by) if isinstance(by, str) else F.struct(*[F.col(f"`{c}`") for c in by])
        aggs.append(F.min_by(first, by).alias("__head"))
    nulls = [F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(f"__null{k}") for k, c in enumerate(have)]
    r = table.agg(*aggs, *nulls).first().asDict()
    n = r["__n"]
    ratios = {c: round(r[f"__null{k}"] or 0.0, 3) for k, c in enumerate(have)} if n else {}
    rates = [ratios.get(c, 1.0) for c in required] if n else []
    total = 1.0 if not n else round(sum(rates) / len(rates), 3) if rates else 0.0
    heads = r.get("__head") or {}
    told = {
        "header": sum(heads[f"h{k}"] == c.lower() for k, c in enumerate(known)) / len(known) if heads else 0.0,
        "tag": float(r["__tag"]),
        "declaration": float(r["__decl"]),
        "duplicate": r.get("__dup") or 0.0,
        "worst": max(rates, default=0.0),
        "mean": sum(rates) / len(rates) if rates else 0.0,
        "masked": r.get("__mask") or 0.0,
    }
    broken = [rule for rule in RULES if rule.broken(told)]
    # required columns that keep the rule still cost by their nulls
    penalty = sum(rule.costs(told) for rule in broken) + (0.0 if REQUIRED in broken else 0.4 * told["mean"])
    return TableReport(name, n, ratios, total, penalty, [rule.says.format(**told) for rule in broken])


@dataclass
class GateReport:
    tables: list[TableReport]

    @property
    def failed(self) -> list[str]:
        return [t.table for t in self.tables if t.failed]

    @property
    def fall_back(self) -> bool:
        return bool(self.failed)

    @property
    def penalty(self) -> float:
        return min(0.95, sum(t.penalty for t in self.tables))


def gate(tables: dict[str, DataFrame], required: dict[str, list[str]], trace: tuple[str, ...] = ()) -> GateReport:
    return GateReport([evaluate(name, t, required.get(name, []), trace) for name, t in tables.items()])
