"""Fill-in-the-middle: texts cut at two units and put in another order, units found by SWAR on 64-bit words.

A unit is a run of ASCII letters or any other single code point. The bytes of
many texts are viewed as uint64 words. In each word all bytes are classified at
once by additions and masks: a byte ends a unit unless the next one is a
continuation byte or both are letters. bitwise_count gives the units of a word,
their running sum is searched for the word that holds the k-th end, and a
multiplication that sums the marks within the word finds the byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Per cent of the texts that stay plain, and of the others that begin with the suffix.
PLAIN, SPM = 10, 20
#: Texts are looked at together up to so many bytes; a longer one by itself.
BLOCK_BYTES = 1 << 22

_ONES, _HIGH, _LOW = (np.uint64(x * 0x0101010101010101) for x in (0x01, 0x80, 0x7F))
_A, _AFTER_Z, _CASE = (np.uint64(x * 0x0101010101010101) for x in (0x80 - ord("a"), 0x80 - ord("z") - 1, 0x20))
_SHIFTED, _ONE, _SEVEN, _BYTE, _REST = (np.uint64(x) for x in (3, 1, 7, 8, 56))


def _followed(marks: np.ndarray) -> np.ndarray:
    """Marks moved to the byte before the marked one."""
    return marks >> _BYTE | np.append(marks[1:], np.uint64(0)) << _REST


class Marks:
    """The ends of units, and the first bytes of code points, in bytes that hold texts back to back.

    data: uint8; bounds: the texts' offsets, one more than texts.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        padded = np.zeros((len(data) // 8 + 1) * 8, np.uint8)
        padded[: len(data)] = data
        x = padded.view("<u8")
        lower = (x | _CASE) & _LOW
        letter = (lower + _A) & ~(lower + _AFTER_Z) & ~x & _HIGH
        continued = x & ~(x << _ONE) & _HIGH
        self.ends = ~(_followed(continued) | letter & _followed(letter)) & _HIGH
        self.firsts = ~continued & _HIGH
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1  # a text ends its last unit, whatever comes after it
        np.bitwise_or.at(self.ends, last >> 3, np.uint64(0x80) << ((last & 7).astype(np.uint64) << _SHIFTED))
        self._ends_before, self._firsts_before = (np.concatenate([[0], np.cumsum(np.bitwise_count(m))]) for m in (self.ends, self.firsts))

    @staticmethod
    def _rank(marks: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many marks lie in the bytes before each place."""
        below = (_ONE << ((at & 7).astype(np.uint64) << _SHIFTED)) - _ONE
        return before[at >> 3] + np.bitwise_count(marks[at >> 3] & below)

    def units(self, at: np.ndarray) -> np.ndarray:
        return self._rank(self.ends, self._ends_before, at)

    def chars(self, at: np.ndarray) -> np.ndarray:
        return self._rank(self.firsts, self._firsts_before, at)

    def after(self, k: np.ndarray) -> np.ndarray:
        """The place after the k-th end of all (from 1)."""
        word = np.searchsorted(self._ends_before, k, "left") - 1
        nth = (k - self._ends_before[word]).astype(np.uint64)
        sums = (self.ends[word] >> _SEVEN) * _ONES  # each byte holds the marks up to it
        short = ((nth - _ONE) * _ONES | _HIGH) - sums & _HIGH  # bytes with fewer than nth
        return word * 8 + np.bitwise_count(short) + 1


def draws(doc_id: int | None, seed: int, n: int = 4) -> list[int]:
    """n numbers below 2**32, given by the id and the seed alone; no id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(n)]


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _block(ids: list, offsets: np.ndarray, data: np.ndarray, seed: int, plain: int, spm: int) -> pa.RecordBatch:
    """ids and the offsets of their texts in data."""
    base = int(offsets[0])
    bounds, raw = (offsets - base).astype(np.int64), data[base : int(offsets[-1])]
    marks = Marks(raw, bounds)
    from_, n = marks.units(bounds[:-1]), np.diff(marks.units(bounds))
    h = np.array([draws(i, seed) for i in ids], np.int64).reshape(-1, 4)
    cuts = np.sort(h[:, :2] % (n[:, None] + 1), axis=1)
    places = [np.where(c > 0, marks.after(np.maximum(from_ + c, 1)), bounds[:-1]) for c in cuts.T]
    chars = [marks.chars(p) for p in (bounds[:-1], *places)]
    text, sentinels = raw.tobytes(), [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = sentinels
    forms, outputs = [], []
    for k, (a, b, c, d) in enumerate(zip(bounds[:-1].tolist(), places[0].tolist(), places[1].tolist(), bounds[1:].tolist())):
        whole = text[a:d]
        if not whole or h[k, 2] % 100 >= 100 - plain or any(x in whole for x in sentinels):
            forms.append("plain")
            outputs.append(whole)
        elif h[k, 3] % 100 < spm:
            forms.append("spm")
            outputs.append(b"".join((s, text[c:d], p, text[a:b], m, text[b:c])))
        else:
            forms.append("psm")
            outputs.append(b"".join((p, text[a:b], s, text[c:d], m, text[b:c])))
    hidden = np.array([f == "plain" for f in forms], bool)
    sizes = [pa.array(chars[k + 1] - chars[k], pa.int64(), mask=hidden) for k in range(2)]
    columns = [pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(forms, pa.string()), *sizes, pa.array(outputs, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in _SCHEMA.split(", ")])


def _rearranged(seed: int, plain: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column("text").cast(pa.large_string())
            _, offsets, data = texts.buffers()
            at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            ids, a = batch.column("doc_id").to_pylist(), 0
            while a < len(ids):
                b = max(a + 1, int(np.searchsorted(at, at[a] + BLOCK_BYTES, "right")) - 1)
                yield _block(ids[a:b], at[a : b + 1], bytes_, seed, plain, spm)
                a = b

    return run


def rearranged(docs: DataFrame, seed: int = 1, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """One row for each document: doc_id, n, form, prefix_chars, middle_chars, output.

    n counts the units of the whole text; both cuts are drawn by doc_id and seed
    from 0 to n, and may be equal. form is psm (prefix, suffix, middle, each after
    its sentinel), spm (suffix first) or plain: the text as it is, for an empty or
    null text, one that holds a sentinel, and plain per cent of the rest. The
    chars are code points, null where plain. A null id draws as an empty one; rows
    that repeat an id and a text give the same output each. Long texts are never
    split or cut; other columns are left behind.
    """
    d = columns_of(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return d.mapInArrow(_rearranged(seed, plain, spm), _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no sentinel occurs in a text that was cut, so they split it exactly."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second, middle = parts[1], parts[2], parts[3]
    return F.when(form == "psm", F.concat(first, middle, second)).when(form == "spm", F.concat(second, middle, first)).otherwise(output)


SQL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
), drawn AS (
  SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(u) + 1) AS c1, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(u) + 1) AS c2,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:least(c1, c2)], ''), '') AS p,
         coalesce(array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], ''), '') AS m, coalesce(array_to_string(u[greatest(c1, c2) + 1:], ''), '') AS s
  FROM drawn
), made AS (
  SELECT doc_id, n, form, p, m, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o
  FROM parts
), split AS (SELECT *, regexp_split_to_array(o, '<P>|<S>|<M>') AS x FROM made)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(o) AS output_sha256, sha256(CASE form WHEN 'plain' THEN o WHEN 'psm' THEN x[2] || x[4] || x[3] ELSE x[3] || x[4] || x[2] END) AS restored_sha256
FROM split
"""
