"""Personal data by candidate gradient boosting, in DataFrame operations only.

Exact patterns give the base spans. High-recall generators propose overlapping
candidates besides: anything around an @ and mail addresses in words, any longer
run of digits, any long token, and whatever is assigned to a secret's name.
Their format and context become a few small features. The counts of each
feature combination over the whole corpus are all that boosting needs, and all
of them are used: each tree is fitted to sums over every combination. Spark adds
them up where they are more than COMBINATIONS, the driver where they are fewer,
with the same result. The trees are applied as SQL expressions, and a candidate
becomes a span where the score reaches the threshold calibrated for its
generator.

Weak labels: a candidate is positive if a base rule confirms it, if the words
before it name what it is (a phone, a card, a mail address, a secret), or if it
bears the prefix of a known issuer of keys. None of these is a feature, so the
trees carry the verdict over to candidates of the same format that nothing
names: a format is taken where about as many held-out candidates are named as
are not. Thresholds are calibrated on scores of held-out documents: FOLDS
models, each blind to the documents that it scores.

What is written to the shared folder holds places and features, no text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stash

KINDS = ("email", "ip", "card", "phone", "secret")

# The base patterns. Possessive quantifiers and the look-behinds
# match the same spans as the plain forms and keep the search linear.
_MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Generators of candidates.
_AROUND_AT = r"(?<![^\s@])[^\s@]++@[^\s@]++"
_IN_WORDS = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64}+ ?[\[( ](?:at|@)[\]) ] ?[A-Za-z0-9-]{2,64}+(?: ?[\[( ](?:dot|\.)[\]) ] ?[A-Za-z]{2,24}+)++"
_DIGITS = r"\+?+\(?+[0-9](?:[\x20().-]{0,2}+[0-9])*+"
_TOKEN = r"\b[A-Za-z0-9_/+-]{16,}+={0,2}+"
_NAME = r"(?i)(?:token|secret|key|password|passwd|pwd|credential|auth)[A-Za-z0-9_-]{0,20}+\s{0,3}+[=:]\s{0,3}+[\x22\x27]?+"
_ASSIGNED = _NAME + r"[^\s\x22\x27<>,;]{6,64}+"
# What the words before a candidate call it, by generator, and prefixes of known issuers of keys (fixed values).
_NAMED = {
    0: r"(?i)\b(?:e-?mail|mail|contact|write)\b[^\n]{0,6}$",
    1: r"(?i)\b(?:tele?phone|phone|tel|call|mobile|cell|fax|card|visa|mastercard|account|iban|ssn)\b[^0-9\n]{0,8}$",
    2: _NAME + "$",
}
_ISSUED = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|AIza|eyJ)"

FEATURES = ("gen", "len", "dig", "runs", "sep", "prev", "next", "hex", "plus", "dots", "upper", "lower", "check")
TREES, RATE, FOLDS = 40, 0.3, 5
#: What a held-out candidate that nothing names costs where a threshold lets it through, if a named one gains 1.
COST = 1.0
#: The most feature combinations that come to the driver; of more, Spark takes the same sums where they lie.
COMBINATIONS = 50_000
#: A score is a whole number of thousandths and at most LIMIT of them from zero, so it is the same wherever it is taken.
UNIT, LIMIT = 1000, 30_000
#: Every feature value is below.
VALUES = 16
#: Arrays are walked in parts of so many items, so that what a walk has gathered is copied rarely.
PART = 512
#: Up to so many base spans a candidate is held against each, beyond by binary search.
FEW = 16

#: A span as one number that sorts by start, then end.
_KEY = "(cast({0}.s as bigint) * 4294967296 + {0}.e)"


def _pieces(name: str, pattern: str, when: Column) -> dict[str, Column]:
    """The pieces of text between leftmost matches that don't overlap, and the matches."""
    none = F.expr("cast(array() as array<string>)")
    found = {f"__p_{name}": f"split(text, r'{pattern}', -1)", f"__m_{name}": f"regexp_extract_all(text, r'{pattern}', 0)"}
    return {k: F.when(when, F.expr(x)).otherwise(none) for k, x in found.items()}


def _bound(value: str, name: str, body: str) -> str:
    """SQL: body, in which name stands for value, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _walked(array: str, zero: str, state: str, out: str, kind: str) -> str:
    """SQL: what a walk over array gathers: of z (at: the state, out: the array so far) and item x, the next of both.

    Each part's array is gathered by itself and all are joined in the end.
    """
    none = lambda k: f"cast(array() as array<{k}>)"
    part = f"aggregate(part, named_struct('at', w.at, 'out', {none(kind)}), (z, x) -> named_struct('at', {state}, 'out', {out}))"
    step = _bound(part, "told", "named_struct('at', told.at, 'out', array_append(w.out, told.out))")
    parts = f"transform(sequence(0, greatest(0, (size(whole) - 1) div {PART})), k -> slice(whole, k * {PART} + 1, {PART}))"
    return _bound(array, "whole", f"aggregate({parts}, named_struct('at', {zero}, 'out', {none(f'array<{kind}>')}), (w, part) -> {step}, w -> flatten(w.out))")


def _placed(name: str) -> Column:
    """Start, end (code points), value, what stands before and after: pieces and matches alternate, so their lengths give the places."""
    p, m = f"__p_{name}", f"__m_{name}"
    sizes = f"zip_with({p}, {m}, (a, b) -> length(a) + coalesce(length(b), 0))"
    ends = _walked(sizes, "0", "z.at + x", "array_append(z.out, z.at + x)", "int")
    return F.expr(_bound(ends, "ends", f"transform({m}, (v, i) -> named_struct('s', ends[i] - length(v), 'e', ends[i], 'v', v, 'b', right({p}[i], 64), 'a', left({p}[i + 1], 1)))"))


def _below(sorted_: str, value: str) -> str:
    """SQL: how many items of a sorted array of numbers are less than value, by halving."""
    middle = "cast((z.lo + z.hi) div 2 as int)"
    step = f"if(z.lo >= z.hi, z, if({sorted_}[{middle}] < {value}, named_struct('lo', {middle} + 1, 'hi', z.hi), named_struct('lo', z.lo, 'hi', {middle})))"
    return f"aggregate(sequence(1, 32), named_struct('lo', 0, 'hi', size({sorted_})), (z, turn) -> {step}, z -> z.lo)"


def _once(df: DataFrame) -> DataFrame:
    """df, its columns computed once for each row: expressions above a generator aren't merged with those below."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("r")).select("r.*")


def _luhn(digits: str) -> str:
    """SQL: whether a string of digits has a right check digit."""
    return f"""pmod(aggregate(transform(split(reverse({digits}), ''), (c, i) -> cast(c as int) * (1 + i % 2)), 0, (t, d) -> t + d - if(d > 9, 9, 0)), 10) = 0"""


_ONLY = "regexp_replace(x.v, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(x.v, r'\\.'), q -> try_cast(q as double) <= 255)",
    "card": f"length({_ONLY}) between 14 and 19 and {_luhn(_ONLY)}",
    "phone": f"length({_ONLY}) between 10 and 15",
}


def _with_spans(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with email, ip, card, phone: arrays of base spans; around, words, digits, token, assigned: candidates."""
    asks = {"at": "@", "digit": "[0-9]", "plus": r"\+[0-9]", "dot": r"(?i)[\[( ](?:dot|\.)[\]) ]", "long": r"\b[A-Za-z0-9_/+-]{16}", "sets": "[=:]"}
    d = docs.withColumn("text", F.coalesce("text", F.lit("")))
    d = d.withColumns({f"__{k}": F.rlike("text", F.lit(p)) for k, p in asks.items()})  # asked once, so that most texts are scanned no further
    scans = {"email": (_MAIL, "at"), "ip": (_IP, "digit"), "card": (_CARD, "digit"), "phone": (_PHONE, "plus"), "around": (_AROUND_AT, "at"), "words": (_IN_WORDS, "dot"), "digits": (_DIGITS, "digit"), "token": (_TOKEN, "long"), "assigned": (_ASSIGNED, "sets")}
    for k, (p, when) in scans.items():
        d = d.withColumns(_pieces(k, p, F.col(f"__{when}")))
    d = _once(d.select("doc_id", *[_placed(k).alias(k) for k in scans]))
    # what is assigned begins after the name
    value = f"struct(x.s + length(x.name) as s, x.e, substring(x.v, length(x.name) + 1) as v, right(concat(x.b, x.name), 64) as b, x.a)"
    named = f"transform(transform(assigned, x -> struct(x.s, x.e, x.v, x.b, x.a, regexp_extract(x.v, r'{_NAME}', 0) as name)), x -> {value})"
    return d.select("doc_id", *[F.expr(f"filter({k}, x -> {_VALID[k]})").alias(k) for k in _VALID], F.expr("concat(around, words)").alias("around"), "digits", F.expr(f"concat(token, {named})").alias("token"))


def _candidates(spans: DataFrame) -> DataFrame:
    """doc_id, base spans by kind (s, e) and cands: candidates with features, weak label, and whether a base span overlaps."""
    only = "regexp_replace(x.v, '[^0-9]', '')"
    count = lambda pattern, most, of="x.v": f"least({most}, length(regexp_replace({of}, r'{pattern}', '')))"
    share = lambda pattern: f"cast(length(regexp_replace(x.v, r'{pattern}', '')) * 4 div length(x.v) as int)"
    char = lambda c: f"case when {c} = '' or {c} rlike r'\\s' then 0 when {c} in (chr(34), chr(39)) then 1 when {c} in ('=', ':') then 2 else 3 end"
    is_base = f"if(size(all_base) <= {FEW}, exists(all_base, q -> q.s = x.s and q.e = x.e), {_bound(_below('base_keys', _KEY.format('x')), 'k', f'coalesce(get(base_keys, k) = {_KEY.format("x")}, false)')})"
    # the farthest end of the base spans that begin before a place; -1 if there is none
    reach = lambda place: _bound(_below("base_starts", place), "k", "if(k = 0, -1, base_reach[k - 1])")

    def described(source: str, gen: int, label: str, keep: str) -> str:
        # a key may hold a run of digits that passes for a number
        inside = " and not (q.s >= x.s and q.e <= x.e and q.e - q.s < x.e - x.s)" if gen == 2 else ""
        crosses = f"({reach('x.s')} > x.s or {reach('x.e')} > x.e or {is_base})" if gen == 2 else f"({reach('x.e')} > x.s)"
        over = f"if(size(all_base) <= {FEW}, exists(all_base, q -> q.s < x.e and x.s < q.e{inside}), {crosses})"
        return f"""transform(filter({source}, x -> {keep}), x -> named_struct('s', x.s, 'e', x.e,
            'gen', {gen}, 'len', least(11, cast(length(x.v) div 4 as int)), 'dig', {share("[^0-9]")}, 'runs', least(4, size(regexp_extract_all(x.v, '[0-9]+', 0))),
            'sep', {count("[^ ()-]", 5)}, 'prev', {char("right(x.b, 1)")}, 'next', {char("x.a")},
            'hex', cast(x.v rlike '^[0-9a-f]+$' as int), 'plus', cast(startswith(x.v, '+') as int), 'dots', {count("[^.]", 4)},
            'upper', {share("[^A-Z]")}, 'lower', {share("[^a-z]")}, 'check', {f"cast(length({only}) between 14 and 19 and {_luhn(only)} as int)" if gen == 1 else "0"},
            'y', cast({label} as int), 'over', {over}))"""

    named = lambda g: f"x.b rlike r'{_NAMED[g]}'"
    # letters alone after a secret's name are a word about it
    secret = f"({named(2)} and not x.v rlike '^[A-Za-z]+$') or x.v rlike r'{_ISSUED}'"
    parts = [described("around", 0, f"{is_base} or {named(0)}", "true"), described("digits", 1, f"{is_base} or {named(1)}", f"length({only}) >= 7"), described("token", 2, secret, "true")]
    d = _once(spans.withColumn("all_base", F.expr("array_sort(transform(concat(email, ip, card, phone), q -> struct(q.s, q.e)))")))
    d = d.withColumns({"base_starts": F.expr("transform(all_base, q -> q.s)"), "base_keys": F.expr(f"transform(all_base, q -> {_KEY.format('q')})")})
    d = _once(d.withColumn("base_reach", F.expr(_walked("transform(all_base, q -> q.e)", "-1", "greatest(z.at, x)", "array_append(z.out, greatest(z.at, x))", "int"))))
    d = d.withColumn("cands", F.expr(f"concat({', '.join(parts)})"))
    return d.select("doc_id", *[F.expr(f"transform({k}, x -> struct(x.s, x.e))").alias(k) for k in _VALID], "cands")


#: Takes a function of a matrix of combinations to keys and two arrays of whole numbers; returns these, summed by key over all combinations.
Summed = Callable[[Callable[[np.ndarray], tuple[np.ndarray, ...]]], tuple[np.ndarray, ...]]


def _parts(rows: np.ndarray) -> list[np.ndarray]:
    """Of a matrix of combinations, one a column: features; then by fold the counts of all, of positive, of free and of positive free ones."""
    return np.split(rows, len(FEATURES) + FOLDS * np.arange(4))


def _scores(x: np.ndarray, start: int, trees: list[tuple]) -> np.ndarray:
    score = np.full(x.shape[1], start)
    for f, c, f2, c2, a, b, f3, c3, d, e in trees:
        score += np.where(x[f] <= c, np.where(x[f2] <= c2, a, b), np.where(x[f3] <= c3, d, e))
    return np.clip(score, -LIMIT, LIMIT)


def _seen(counts: np.ndarray, k: int) -> np.ndarray:
    """The counts that model k is fitted to: those of every fold but k."""
    return counts.sum(0) - (counts[k] if k < FOLDS else 0)


def _totals(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each model: how many candidates it is fitted to, and how many positive ones."""
    _, n, pos, *_ = _parts(rows)
    return np.arange(FOLDS + 1), *(np.array([_seen(counts, k).sum() for k in range(FOLDS + 1)]) for counts in (n, pos))


def _slopes(models: list[tuple], roots: dict[int, tuple], scale: int, rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each model, side of its root's cut (without one: the first), feature and value: gradient and curvature of the loss.

    Those of a combination are rounded to whole parts of 1 / scale, so that their sums don't depend on an order.
    """
    x, n, pos, *_ = _parts(rows)
    cells = np.zeros((2, FOLDS + 1, 2, len(FEATURES), VALUES), np.int64)
    for k, (start, trees) in enumerate(models):
        if trees is None:
            continue
        w = _seen(n, k)
        p = 1 / (1 + np.exp(-_scores(x, start, trees) / UNIT))
        both = np.rint((_seen(pos, k) - w * p) * scale), np.rint(w * p * (1 - p) * scale)
        side = VALUES * (x[roots[k][0]] > roots[k][1]) if k in roots else 0
        for f in range(len(FEATURES)):
            for out, weight in zip(cells, both):
                out[k, :, f] = np.bincount(side + x[f], weight, 2 * VALUES).reshape(2, VALUES)
    g, h = cells.reshape(2, -1)
    some = np.flatnonzero((g != 0) | (h != 0))
    return some, g[some], h[some]


def _levels(models: list[tuple], rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each generator and score by the model that is blind to the fold: positive and other free candidates."""
    x, _, _, free, good = _parts(rows)
    key = np.concatenate([x[0] * (2 * LIMIT + 1) + LIMIT + _scores(x, start, trees or []) for start, trees in models[:FOLDS]])
    some = free.ravel() > 0
    keys, at = np.unique(key[some], return_inverse=True)
    return keys, *(np.bincount(at, v.ravel()[some], len(keys)).astype(np.int64) for v in (good, free - good))


class Boosted:
    """Trees of two levels over small integer features, fitted by Newton steps on the logistic loss.

    x: feature rows, y: labels, weight: counts, fold: which held-out part each
    row belongs to, free: whether it overlaps no base span. cut: for each
    generator the score from which on held-out free candidates gain most (see
    COST); no candidate of a generator passes where none gains.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, fold: np.ndarray, free: np.ndarray):
        n = weight * (np.arange(FOLDS)[:, None] == fold)
        rows = np.concatenate([x.T, n, n * y, n * free, n * y * free]).astype(np.int64)
        self._fit(lambda ask: ask(rows))

    @classmethod
    def of(cls, summed: Summed) -> Boosted:
        """Fitted to combinations that only summed knows."""
        made = cls.__new__(cls)
        made._fit(summed)
        return made

    def _fit(self, summed: Summed) -> None:
        self.cut = {g: np.inf for g in range(3)}
        models = self._fitted(summed)  # one for each fold, blind to it, and one of all
        self.start, self.trees = models[-1][0], models[-1][1] or []
        if not self.trees:
            return
        keys, good, rest = summed(partial(_levels, models))
        gen, level = np.divmod(keys, 2 * LIMIT + 1)
        for g in self.cut:
            own = np.flatnonzero(gen == g)
            own = own[np.argsort(-level[own])]
            if len(own):
                gain = np.cumsum(good[own] - COST * rest[own])
                best = int(gain.argmax())
                if gain[best] > 0:
                    self.cut[g] = int(level[own][best]) - LIMIT

    @classmethod
    def _fitted(cls, summed: Summed) -> list[tuple[int, list[tuple] | None]]:
        """Start and trees of every model, fitted side by side; no trees where there is nothing to tell apart."""
        keys, n, pos = summed(_totals)
        models = [(0, None)] * (FOLDS + 1)
        for k, all_, good in zip(keys, n, pos):
            if 0 < good < all_:
                models[k] = (int(np.rint(UNIT * np.log(good / (all_ - good)))), [])
        scale = 1 << max(0, 50 - int(max(n, default=0)).bit_length())  # doubles hold whole sums up to 2^53
        for _ in range(TREES):
            if models[-1][1] is None:
                break
            roots = {}
            for turn in range(2):
                cells = np.zeros((2, (FOLDS + 1) * 2 * len(FEATURES) * VALUES), np.int64)
                at, *sums = summed(partial(_slopes, models, roots, scale))
                cells[:, at] = sums
                cells = cells.reshape(2, FOLDS + 1, 2, len(FEATURES), VALUES) / scale
                found = {}
                for k, (_, trees) in enumerate(models):
                    if trees is None:
                        continue
                    if not turn:
                        found[k] = cls._best(*cells[:, k, 0])
                        continue
                    tree = [*roots[k]]
                    for side in range(2):
                        f, c = cls._best(*cells[:, k, side])
                        g, h = cells[:, k, side, f]
                        tree += [f, c, *(int(np.rint(UNIT * RATE * g[part].sum() / (h[part].sum() + 1))) for part in (slice(c + 1), slice(c + 1, None)))]
                    trees.append(tuple(tree))
                roots = found
        return models

    @staticmethod
    def _best(g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        """The feature and the cut of the greatest gain, from sums by feature and value."""
        gs, hs = np.cumsum(g, axis=1), np.cumsum(h, axis=1)
        gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1)
        c = gain.argmax(1)
        return max((float(gain[f, k]), f, int(k)) for f, k in enumerate(c))[1:]

    def sql(self, c: str) -> str:
        """The score of candidate c."""
        side = lambda f, k, a, b: f"if({c}.{FEATURES[f]} <= {k}, {a}L, {b}L)"
        total = " + ".join([f"{self.start}L", *(f"if({c}.{FEATURES[t[0]]} <= {t[1]}, {side(*t[2:6])}, {side(*t[6:10])})" for t in self.trees)])
        return f"least({LIMIT}L, greatest(-{LIMIT}L, {total}))"

    def lets(self, c: str) -> str:
        cuts = [f"({c}.gen = {g} and {self.sql(c)} >= {v}L)" for g, v in self.cut.items() if np.isfinite(v)]
        return " or ".join(cuts) or "false"


def _matrix(columns: list) -> np.ndarray:
    return np.array([c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy() for c in columns], np.int64).reshape(len(columns), -1)


def _sums(table: DataFrame, ask: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """See Summed: by Spark, over the rows of a table of combinations."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in ask(_matrix(b.columns))], ["key", "a", "b"])

    got = table.mapInArrow(parts, "key long, a long, b long").groupBy("key").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    return tuple(_matrix(got.columns))


def fit(cands: DataFrame) -> Boosted:
    """From rows of _candidates(): every combination of features, counted whole in each fold of documents."""
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).alias("fold")
    kinds = ("true", "y = 1", "not over", "y = 1 and not over")
    counts = [F.expr(f"count_if(fold = {k} and {kind})").alias(f"n{i}_{k}") for i, kind in enumerate(kinds) for k in range(FOLDS)]
    table = stash(cands.select(fold, F.explode("cands").alias("c")).select("fold", "c.*").groupBy(*FEATURES).agg(*counts), "pii-combinations")
    if table.count() > COMBINATIONS:
        return Boosted.of(partial(_sums, table))
    rows = _matrix(table.toArrow().columns)
    return Boosted.of(lambda ask: ask(rows))


def find(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans.

    spans are kind:start:end (code points, end exclusive) by start, then kind
    as listed, comma-joined; base_sha256 is over the base spans alone; n_added
    and n_spans count the spans that the trees added and all of them. A null
    text is empty. Rows that repeat a doc_id report for themselves. A candidate
    that overlaps a base span adds none, but a token may hold one; of added
    spans that overlap, the first by start, the longest there, stays.
    """
    rows = stash(_candidates(_with_spans(columns_of(docs, doc_id="long", text="string"))), "pii-candidates")
    model = fit(rows)
    kind = "case c.gen when 0 then 0 when 2 then 4 else if(c.plus = 1, 3, case when c.dots >= 3 then 1 when c.len >= 3 and c.sep = 0 or c.len >= 4 then 2 else 3 end) end"
    added = f"array_sort(transform(filter(cands, c -> not c.over and ({model.lets('c')})), c -> named_struct('s', c.s, 'k', {kind}, 'e', c.e)), (a, b) -> case when a.s != b.s then a.s - b.s else b.e - a.e end)"
    once = _walked("added", "-1", "if(x.s < z.at, z.at, x.e)", "if(x.s < z.at, z.out, array_append(z.out, x))", "struct<s:int,k:int,e:int>")
    base = "concat(" + ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {i}, 'e', x.e))" for i, k in enumerate(_VALID)) + ")"
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda a: f"array_join(transform(array_sort({a}), x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"
    rows = rows.withColumn("added", F.expr(added)).withColumn("added", F.expr(once)).withColumn("base", F.expr(base))
    counts = [F.size("added").cast("long").alias("n_added"), (F.size("added") + F.size("base")).cast("long").alias("n_spans")]
    return rows.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in _VALID], F.sha2(F.expr(joined("base")), 256).alias("base_sha256"), F.expr(joined("concat(base, added)")).alias("spans"), *counts)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, each text with every span of find() replaced by its kind in brackets.

    A null text stays null. Rows that repeat a doc_id are redacted each by its
    own spans: rows and spans meet by id and text hash, of which find() sees
    each pair once.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash of the text stands in for the id, so equal texts share their spans
    spans = find(texts.dropna(subset=["text"]).select(F.xxhash64("text").alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    parsed = spans.select(F.col("doc_id").alias("of"), F.expr("filter(transform(split(spans, ','), x -> split(x, ':')), p -> size(p) = 3)").alias("p"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    met = packed.join(parsed, F.xxhash64("text") == F.col("of"), "left")
    text = F.expr("""aggregate(coalesce(p, array()), named_struct('at', 0, 'out', ''),
        (z, x) -> if(cast(x[1] as int) < z.at, z, named_struct('at', cast(x[2] as int), 'out', concat(z.out, substring(text, z.at + 1, cast(x[1] as int) - z.at), '[', x[0], ']'))),
        z -> concat(z.out, substring(text, z.at + 1, length(text))))""")
    return met.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
