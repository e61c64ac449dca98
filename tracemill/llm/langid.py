"""Language identification by a bidirectional gated recurrent network over bytes.

Trained in numpy by backpropagation through time on windows of labelled texts;
applied to every byte of every text. Each position gets a distribution over
the languages from the states on both sides, and a document's is their mean.
Texts are cut into pieces of PIECE bytes that run side by side. Gates use the
clipped line and the candidate state x / (1 + |x|), cheap forms of the sigmoid
and the hyperbolic tangent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, raw_texts

#: Training takes at most so many documents of a language (the lowest by hash), so many of all, and so many bytes of each.
DOCS_A_LANG, DOCS, BYTES_A_DOC = 300, 20_000, 1024
HIDDEN, PIECE, BATCH, STEPS, SEED = 8, 64, 192, 160, 11
_LANES = 2048


def has_letter(text: str) -> bool:
    """Whether text has a letter of any script; digits, fractions and numerals of any kind are none."""
    return any(map(str.isalpha, text))


class Net:
    """Rows of w: update, reset, candidate gate; each forward then backward. Arrays are (units, lanes)."""

    def __init__(self, langs: list[str], seed: int = SEED):
        rng, h = np.random.RandomState(seed), HIDDEN
        self.langs = langs
        # the byte's share of each gate (256: padding), the states' share, the read-out
        self.p = {"x": rng.normal(0, 0.3, (2, 3 * h, 257)), "u": rng.normal(0, 0.5 / h**0.5, (2, 3 * h, h)), "o": rng.normal(0, 0.3, (len(langs), 2 * h)), "c": np.zeros((len(langs), 1))}
        self.p["x"][:, :h] += 0.5
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def states(self, codes: np.ndarray, d: int, keep: list | None = None) -> np.ndarray:
        """(time, units, lanes) of direction d over codes (time, lanes)."""
        h, x, u = HIDDEN, self.p["x"][d], self.p["u"][d]
        now = np.zeros((h, codes.shape[1]), np.float32)
        out = np.empty((len(codes), h, codes.shape[1]), np.float32)
        for t in range(len(codes)) if d == 0 else reversed(range(len(codes))):
            a, b = x.take(codes[t], axis=1), u @ now
            gates = a[: 2 * h] + b[: 2 * h]
            gates *= 0.25
            gates += 0.5
            np.clip(gates, 0, 1, gates)
            z, r = gates[:h], gates[h:]
            n = r * b[2 * h :]
            n += a[2 * h :]
            soft = np.abs(n)
            soft += 1
            n /= soft
            if keep is not None:
                keep.append((t, now, z, r, b[2 * h :], soft, n))
            now = n + z * (now - n)
            out[t] = now
        return out

    def probabilities(self, both: np.ndarray) -> np.ndarray:
        """(units, positions) -> (languages, positions)."""
        y = self.p["o"] @ both + self.p["c"]
        y -= y.max(0)
        np.exp(y, y)
        y /= y.sum(0)
        return y

    def gradients(self, codes: np.ndarray, lang: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross-entropy over positions that are no padding, back through time."""
        h, (steps, lanes) = HIDDEN, codes.shape
        kept: list[list] = [[], []]
        both = np.concatenate([self.states(codes, 0, kept[0]), self.states(codes, 1, kept[1])], axis=1)
        flat = both.transpose(1, 0, 2).reshape(2 * h, -1)
        y = self.probabilities(flat)
        y[np.tile(lang, steps), np.arange(steps * lanes)] -= 1
        real = (codes != 256).reshape(-1)
        y *= real / max(real.sum(), 1)
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["o"], g["c"] = y @ flat.T, y.sum(1, keepdims=True)
        back = (self.p["o"].T @ y).reshape(2 * h, steps, lanes)
        for d in (0, 1):
            u, later = self.p["u"][d], np.zeros((h, lanes), np.float32)
            for t, before, z, r, un, soft, n in reversed(kept[d]):
                dh = back[d * h : d * h + h, t] + later
                dn = dh * (1 - z) / soft**2
                dz = dh * (before - n) * ((z > 0) & (z < 1)) * 0.25
                dr = dn * un * ((r > 0) & (r < 1)) * 0.25
                da = np.concatenate([dz, dr, dn])
                db = np.concatenate([dz, dr, dn * r])
                np.add.at(g["x"][d].T, codes[t], da.T)
                g["u"][d] += db @ before.T
                later = dh * z + u.T @ db
        return g

    def train(self, texts: list[bytes], langs: list[str], steps: int = STEPS) -> Net:
        rng = np.random.RandomState(SEED)
        of = {x: k for k, x in enumerate(self.langs)}
        own = [[t for t, x in zip(texts, langs) if x == name and t] for name in self.langs]
        known = [k for k in range(len(own)) if own[k]]
        if not known or len(of) < 2:
            return self
        m, v = ({k: np.zeros_like(x) for k, x in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            lang = rng.choice(known, BATCH)
            codes = np.full((PIECE, BATCH), 256)
            for j, k in enumerate(lang):
                text = own[k][rng.randint(len(own[k]))]
                at = rng.randint(max(1, len(text) - PIECE + 1))
                piece = np.frombuffer(text[at : at + PIECE], np.uint8)
                codes[: len(piece), j] = piece
            g = self.gradients(codes, lang)
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            rate = 0.03 * (1 - step / (steps + 1)) + 0.001
            for k, x in g.items():
                x = x * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * x
                v[k] = 0.99 * v[k] + 0.01 * x * x
                self.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): the mean distribution over all bytes of each text."""
        lengths = np.array([len(t) for t in texts], np.int64)
        pieces = -(-lengths // PIECE)
        buffer = np.full(int(pieces.sum()) * PIECE, 256, np.int16)
        at = 0
        for t, k in zip(texts, pieces):
            buffer[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += int(k) * PIECE
        grid, owner = buffer.reshape(-1, PIECE), np.repeat(np.arange(len(texts)), pieces)
        total = np.zeros((len(texts), len(self.langs)))
        for k in range(0, len(grid), _LANES):
            codes = np.ascontiguousarray(grid[k : k + _LANES].T).astype(np.intp)
            both = np.concatenate([self.states(codes, 0), self.states(codes, 1)], axis=1)
            sums = np.zeros((len(self.langs), codes.shape[1]), np.float32)
            for t in range(PIECE):
                y = self.probabilities(both[t])
                y *= codes[t] != 256
                sums += y
            np.add.at(total, owner[k : k + _LANES], sums.T)
        return total / np.maximum(lengths, 1)[:, None]


def held_out(doc_id: str = "doc_id"):
    """Documents that nothing is learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame) -> Net:
    """Learns from text and non-null lang of documents that aren't held out, a bounded sample of each language.

    Every lang value that occurs is learned; where there are many, each has fewer
    documents (one at least). Where no language is labelled the net has none, and
    every text is und.
    """
    d = columns_of(docs, doc_id="long", text="string", lang="string").dropna().where(~held_out() & (F.length("text") > 0))
    known = d.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").collect()
    if not known:
        return Net([])
    each = max(1, min(DOCS_A_LANG, DOCS // len(known)))
    # a cut by hash for each language keeps what moves near so many rows of it
    cut = F.create_map(*[F.lit(x) for r in known for x in (r.lang, int((1.2 * each + 200) / r.n * (1 << 30)) + 1)])
    d = d.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < cut[F.col("lang")])
    # a window of each text, from a place that its hash gives
    start = F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.length("text") - BYTES_A_DOC + 1, F.lit(1))).cast("int")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")))).where(F.col("rank") <= each)
    rows = d.select("lang", "rank", F.substring("text", start + 1, F.lit(BYTES_A_DOC)).alias("text")).orderBy("rank", "lang").collect()
    langs = sorted({r.lang for r in rows})
    net = Net(langs)
    return net.train([r.text.encode() for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, net: Net) -> DataFrame:
    """One row for each document: doc_id, held_out, lang_pred, score.

    lang_pred is und, with score 0, if the text is null or has no letter, or
    if no language was learned. Of languages as probable as each other the first
    by name is taken. Rows that repeat each other are predicted each.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = list(raw_texts(batch.column("text")))
            lettered = [k for k, x in enumerate(raw) if x and net.langs and has_letter(x.decode("utf-8", "replace"))]
            names, scores = ["und"] * len(raw), np.zeros(len(raw))
            if lettered:
                p = net.pooled([raw[k] for k in lettered])
                best = p.argmax(1)
                for k, b, s in zip(lettered, best, p.max(1)):
                    names[k], scores[k] = net.langs[b], min(1.0, float(s))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = columns_of(docs, doc_id="long", text="string").select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(each, "doc_id long, held_out boolean, lang_pred string, score double")
