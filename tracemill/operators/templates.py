"""Log templates: lines with their variable parts replaced, counted and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.shared import written

EXAMPLES, EXAMPLE_CHARS = 5, 1000


def _skeletons(lines: DataFrame) -> DataFrame:
    d = lines.where(F.col("line").rlike(r"\S"))
    return d.select(S.skeleton(F.col("line")).alias("skeleton"), "file_id", "line_no", F.substring("line", 1, EXAMPLE_CHARS).alias("line"))


def counts(lines: DataFrame) -> DataFrame:
    """template_id, skeleton, count, first_seen, last_seen (line numbers); counts combine before the shuffle, ids are hashed after it."""
    g = _skeletons(lines).groupBy("skeleton").agg(F.count("*").alias("count"), F.min("line_no").alias("first_seen"), F.max("line_no").alias("last_seen"))
    return g.select(S.template_id(F.col("skeleton")).alias("template_id"), "skeleton", "count", "first_seen", "last_seen")


def examples(lines: DataFrame) -> DataFrame:
    """template_id, examples: the first five lines of each template.

    Each task keeps its first five of a template, so no list grows with a
    template's lines.
    """
    nth = F.row_number().over(Window.partitionBy("skeleton").orderBy("file_id", "line_no"))
    few = _skeletons(lines).withColumn("nth", nth).where(F.col("nth") <= EXAMPLES).groupBy("skeleton").agg(F.sort_array(F.collect_list(F.struct("nth", "line"))).alias("told"))
    return few.select(S.template_id(F.col("skeleton")).alias("template_id"), F.transform("told", lambda x: x["line"]).alias("examples"))


def mine(lines: DataFrame) -> DataFrame:
    """Templates with counts and examples."""
    return counts(lines).join(examples(lines), "template_id")


def top(templates: DataFrame, n: int = 20) -> DataFrame:
    return templates.orderBy(F.desc("count"), F.desc("last_seen"), "template_id").limit(n)


def stats(templates: DataFrame) -> DataFrame:
    return templates.agg(F.count("*").alias("n_templates"), F.max("count").alias("max_count"), F.count_if(F.col("count") >= 100).alias("n_frequent"))


def evict(templates: DataFrame, limit: int = 5000) -> DataFrame:
    """Above limit the tenth with the lowest (count, last_seen) goes."""
    n = templates.count()
    if n < limit:
        return templates
    return templates.join(templates.orderBy("count", "last_seen", "template_id").limit(max(1, n // 10)).select("template_id"), "template_id", "left_anti")


def similar_pairs(templates: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(a, b, score) for template pairs whose word sets overlap by threshold or more, a < b.

    Two sets of sizes n and m that overlap so much share one of the rarest
    n - ceil(t n) + 1 words of the larger; only pairs that meet on such a word
    are compared.
    """
    words = F.array_distinct(F.filter(F.split("skeleton", " "), lambda w: w != ""))
    t = templates.select("template_id", words.alias("words")).withColumn("n", F.size("words"))
    each = t.select("template_id", "n", F.explode("words").alias("word"))
    rarity = each.groupBy("word").agg(F.count("*").alias("held_by"))
    rank = F.row_number().over(Window.partitionBy("template_id").orderBy("held_by", "word"))
    prefix = each.join(rarity, "word").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("template_id", "n", "word")
    a, b = prefix.alias("a"), prefix.alias("b")
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & (F.col("a.template_id") < F.col("b.template_id")) & (F.least("a.n", "b.n") >= F.greatest("a.n", "b.n") * threshold - 1e-9))
    met = met.select(F.col("a.template_id").alias("a"), F.col("b.template_id").alias("b")).distinct()
    x, y = t.select(F.col("template_id").alias("a"), F.col("words").alias("x")), t.select(F.col("template_id").alias("b"), F.col("words").alias("y"))
    score = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return met.join(x, "a").join(y, "b").select("a", "b", score.alias("score")).where(F.col("score") >= threshold - 1e-9)


def merged_into(templates: DataFrame, threshold: float = 0.95) -> DataFrame:
    """template_id, merged_into: the first seen earlier template that is similar; null for the others."""
    p = similar_pairs(templates, threshold)
    both = p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b")))
    seen = templates.select("template_id", "first_seen")
    d = both.join(seen.select(F.col("template_id").alias("a"), F.col("first_seen").alias("at")), "a").join(seen.select(F.col("template_id").alias("b"), F.col("first_seen").alias("before")), "b")
    d = d.where(F.struct("before", "b") < F.struct("at", "a")).groupBy("a").agg(F.min(F.struct("before", "b"))["b"].alias("merged_into"))
    return templates.join(d.withColumnRenamed("a", "template_id"), "template_id", "left").select("template_id", "merged_into")


def evolve(templates: DataFrame, threshold: float = 0.92) -> DataFrame:
    """Similar templates as one: the most frequent of each group of linked ones, counts summed, up to ten examples.

    Groups are found by passing the winner along the links, and on to those who
    follow it, until nothing changes; merged templates are never met again.
    """
    t = written(templates.withColumn("rank", F.struct((-F.col("count")).alias("less"), "first_seen", "template_id")))
    p = similar_pairs(templates, threshold)
    both = written(p.select("a", "b").unionByName(p.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    best, changed = t.select(F.col("template_id").alias("b"), F.col("rank").alias("best")), True
    while changed:
        passed = both.join(best, "b").groupBy(F.col("a").alias("b")).agg(F.min("best").alias("seen"))
        after = best.join(passed, "b", "left").select("b", F.col("best").alias("was"), F.least("best", F.coalesce("seen", "best")).alias("best"))
        leader = best.select(F.col("b").alias("of"), F.col("best").alias("further"))
        after = after.join(leader, F.col("best.template_id") == F.col("of"), "left").select("b", "was", F.least("best", F.coalesce("further", "best")).alias("best"))
        after = written(after)
        changed = bool(after.where("was != best").limit(1).count())
        best = after.select("b", "best")
    d = t.join(best.select(F.col("b").alias("template_id"), F.col("best").alias("winner")), "template_id")
    g = d.groupBy("winner").agg(F.sum("count").alias("count"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.min_by(F.struct("template_id", "skeleton"), "rank").alias("w"), F.count("*").alias("n_merged"), F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "examples"))), lambda x: x["examples"])), 1, 10).alias("examples"))
    return g.select("w.template_id", "w.skeleton", "count", "first_seen", "last_seen", "n_merged", "examples")


def drift(skeletons: DataFrame, baseline: str | None, recent: int = 100) -> DataFrame:
    """drift: 1 - mean overlap of a baseline skeleton with the last skeletons (line_no, skeleton); 0 if unknown."""
    last = skeletons.orderBy(F.desc("line_no")).limit(recent)
    return last.agg(F.bround(F.coalesce(1 - F.avg(S.jaccard(F.lit(baseline), F.col("skeleton"))), F.lit(0.0)), 3).alias("drift"))
