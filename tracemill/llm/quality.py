"""Quality rules: an isolation forest over rule statistics, thresholds calibrated on labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns_of, hash_sample, raw_texts

#: At most so many labelled rows, the lowest by hash, fit the forest and its threshold.
SAMPLE_ROWS = 4000
TREES, TREE_ROWS, SEED = 200, 256, 7
#: Rows labelled bad that the trees see, as a share of the good ones: anomalies must be few to be isolated early.
BAD_SHARE = 0.02
#: The threshold may reject at most this share of the rows labelled good.
GOOD_LOSS = 0.003

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_EXTRA = ("n_upper", "n_letters", "n_digits")

# The symbols and the white space that the rules count.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\t\n\x0b\x0c\r "


def _repeated(words: list[bytes]) -> int:
    """Words that lie in a five-word window found twice or more."""
    n = len(words)
    if n < 6:
        return 0
    last = dict(zip(words, range(n)))
    if len(last) == n:
        return 0
    ids = np.fromiter(map(last.__getitem__, words), np.int64, n)
    base = n
    if base**5 >= 2**63:
        ids = np.unique(ids, return_inverse=True)[1]
        base = len(last)
    key, wide = ids[:-4].copy(), base
    for j in range(1, 5):
        if wide * base >= 2**63:
            key = np.unique(key, return_inverse=True)[1]
            wide = n
        key = key * base + ids[j : n - 4 + j]
        wide *= base
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    again = np.isin(key, np.unique(twice))
    covered = np.zeros(n, bool)
    for j in range(5):
        covered[j : n - 4 + j] |= again
    return int(covered.sum())


def rule_counts(raw: bytes | None) -> tuple[int, ...]:
    """BASE and then _EXTRA of one UTF-8 text; a null text counts as empty."""
    raw = raw or b""
    bytes_of = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    chars = len(raw) - int(bytes_of[0x80:0xC0].sum())
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return (
        len(words),
        chars - int(bytes_of[list(SPACES)].sum()),
        int(bytes_of[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        _repeated(words),
        int(bytes_of[65:91].sum()),
        int(bytes_of[65:91].sum() + bytes_of[97:123].sum() + bytes_of[0xC0:].sum()),
        int(bytes_of[48:58].sum()),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """Rows of counts -> what the trees split on: logarithms of ratios, so that length alone is no anomaly."""
    n, chars, _, _, repeated, upper, letters, digits = counts.astype(float).T
    other = np.maximum(chars - letters - digits, 0)
    words = np.maximum(n, 1)
    return np.log(np.stack([other / np.maximum(chars, 1) + 0.02, other / words + 0.1, upper / np.maximum(letters, 1) + 0.01, repeated / words + 0.05], axis=1))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 10) | (100 * counts[:, 4] > 20 * counts[:, 0])


class IsolationForest:
    """Random splits isolate odd rows after few of them: score = 2 ** (-mean path / expected path)."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        rng = np.random.RandomState(seed)
        size = min(tree_rows, len(rows))
        self.expected = _average_path(size)
        deepest = max(1, int(np.ceil(np.log2(max(size, 2)))))
        grown = [self._grow(rows[rng.choice(len(rows), size, replace=False)], rng, deepest) for _ in range(trees)]
        most = max(len(x) for x in grown)
        # [tree, node] -> feature (-1: leaf), cut, left child, path length at a leaf
        self.nodes = np.zeros((trees, most, 4))
        for k, x in enumerate(grown):
            self.nodes[k, : len(x)] = x
        self.deepest = deepest

    @staticmethod
    def _grow(rows: np.ndarray, rng: np.random.RandomState, deepest: int) -> list[list[float]]:
        nodes: list[list[float]] = [[]]
        todo = [(0, rows, 0)]
        while todo:
            at, part, depth = todo.pop()
            low, high = part.min(0), part.max(0)
            varied = np.flatnonzero(high > low)
            if depth >= deepest or len(part) < 2 or not len(varied):
                nodes[at] = [-1, 0, 0, depth + _average_path(len(part))]
                continue
            f = rng.choice(varied)
            cut = rng.uniform(low[f], high[f])
            left = part[:, f] < cut
            child = len(nodes)
            nodes[at] = [f, cut, child, 0]
            nodes += [[], []]
            todo += [(child, part[left], depth + 1), (child + 1, part[~left], depth + 1)]
        return nodes

    def score(self, rows: np.ndarray) -> np.ndarray:
        total, at_row = np.zeros(len(rows)), np.arange(len(rows))
        for nodes in self.nodes:
            feature, cut, child, path = nodes.T
            feature, child = feature.astype(int), child.astype(int)
            at = np.zeros(len(rows), int)
            for _ in range(self.deepest):
                f = feature[at]
                step = child[at] + (rows[at_row, np.maximum(f, 0)] >= cut[at])
                at = np.where(f < 0, at, step)
            total += path[at]
        return 2.0 ** (-total / len(self.nodes) / max(self.expected, 1e-9))


def _average_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


class Verdict:
    """Forest and threshold; without labelled rows of both kinds the base rules alone decide."""

    def __init__(self, counts: np.ndarray, quality: np.ndarray):
        self.forest, self.threshold = None, np.inf
        good = quality == 1
        if len(counts) < 16 or good.all() or not good.any():
            return
        rows = features(counts)
        few = np.flatnonzero(~good)[:: max(1, int((~good).sum() / max(8, BAD_SHARE * good.sum())))]
        self.forest = IsolationForest(rows[np.concatenate([np.flatnonzero(good), few])])
        score = self.forest.score(rows)
        # the lowest cut that loses no more good rows than allowed and still catches bad ones
        ordered = np.sort(score[good & ~base_failed(counts)])[::-1]
        if not len(ordered):
            return
        allowed = int(GOOD_LOSS * len(ordered))
        cut = ordered[allowed] + 1e-9
        caught = score[~good] > cut
        if caught.any():
            self.threshold = cut + 0.25 * (score[~good][caught].min() - cut)

    def keeps(self, counts: np.ndarray) -> np.ndarray:
        passed = ~base_failed(counts)
        if self.forest is not None and len(counts):
            passed &= self.forest.score(features(counts)) <= self.threshold
        return passed


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = np.array([rule_counts(x) for x in raw_texts(batch.column("text"))], np.int64).reshape(-1, len(BASE) + len(_EXTRA))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), *[pa.array(counts[:, k]) for k in range(len(BASE) + len(_EXTRA))]], ["doc_id", "quality", *BASE, *_EXTRA])


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Verdict:
    """Fits on at most sample_rows labelled documents; null labels and ids are left out, of labels or rows that repeat an id the least counts."""
    some = hash_sample(columns_of(labels, doc_id="long", quality="int").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality")), sample_rows, "doc_id")
    rows = columns_of(docs, doc_id="long", text="string").join(F.broadcast(some), "doc_id")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in (*BASE, *_EXTRA)]])
    # of rows that repeat an id one stays, so that no more come than were sampled; sorted, the fit is the same on every run
    counts = rows.select("doc_id", "quality", "text").mapInArrow(_count_batches, schema)
    least = counts.groupBy("doc_id").agg(F.min(F.struct("quality", *BASE, *_EXTRA)).alias("x"))
    found = sorted(map(tuple, least.select("x.*").collect()))
    table = np.array(found, np.int64).reshape(-1, 1 + len(BASE) + len(_EXTRA))
    return Verdict(table[:, 1:], table[:, 0])


def judge(docs: DataFrame, verdict: Verdict) -> DataFrame:
    """One row for each document: counts, base_failed, kept. Null and empty texts have no word and fail."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([rule_counts(x) for x in raw_texts(batch.column("text"))], np.int64).reshape(-1, len(BASE) + len(_EXTRA))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(counts[:, k]) for k in range(5)], pa.array(base_failed(counts)), pa.array(verdict.keeps(counts))], ["doc_id", *BASE, "base_failed", "kept"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("doc_id", *BASE)] + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")])
    return columns_of(docs, doc_id="long", text="string").mapInArrow(each, schema)


def filter_quality(docs: DataFrame, verdict: Verdict) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep; no shuffle."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            counts = np.array([rule_counts(x) for x in raw_texts(batch.column(at).cast(pa.string()))], np.int64).reshape(-1, len(BASE) + len(_EXTRA))
            yield batch.filter(pc.fill_null(pa.array(verdict.keeps(counts)), False))

    return docs.mapInArrow(each, docs.schema)
