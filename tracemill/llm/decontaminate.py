"""Benchmark decontamination: pigeonhole edit matching.

An item with an error budget of k edits is split into k + 1 pieces; a copy with
at most k edits holds at least one piece unchanged. Pieces are found exactly in
one pass over a text, and each hit is verified around its diagonal with Myers'
bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, stash

#: One edit for so many characters of the item in normal form. What has no edit to spare must stand between word borders, for a few
#: letters lie in many words.
CHARS_AN_EDIT = 16
#: Bytes of benchmark text that one pass over the documents takes; a larger benchmark takes more passes.
BLOCK_BYTES = 4_000_000


def normal(text: str) -> str:
    """Lower case, each run of white space one space."""
    return " ".join(text.lower().split())


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(edits, end) of the best match of pattern anywhere in text, if it takes at most so many edits."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = (most + 1, -1)
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best[0]:
            best = (score, j + 1)
    return best if best[0] <= most else None


def _inside_word(text: str, start: int, end: int) -> bool:
    """Whether a letter or digit goes on across either end of text[start:end]."""
    return start > 0 and text[start - 1].isalnum() and text[start].isalnum() or end < len(text) and text[end].isalnum() and text[end - 1].isalnum()


class Items:
    """A block of benchmark items and the automaton of their pieces."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, x, len(x) // CHARS_AN_EDIT) for i, x in items if x]
        at: dict[str, list[tuple[int, int]]] = {}
        for n, (_, x, k) in enumerate(self.items):
            cuts = [len(x) * j // (k + 1) for j in range(k + 2)]
            for a, b in zip(cuts, cuts[1:]):
                at.setdefault(x[a:b], []).append((n, a))
        self.pieces = ahocorasick.Automaton()
        for piece, places in at.items():
            self.pieces.add_word(piece, (len(piece), places))
        if at:
            self.pieces.make_automaton()

    def find(self, text: str) -> dict[int, int]:
        """item_id -> fewest edits, for the items that text holds."""
        found: dict[int, int] = {}
        if not self.items:
            return found
        text = normal(text)
        hits: dict[int, set[int]] = {}  # where an item would begin, by its pieces
        for end, (length, places) in self.pieces.iter(text):
            for n, offset in places:
                hits.setdefault(n, set()).add(end + 1 - length - offset)
        for n, starts in hits.items():
            item, x, k = self.items[n]
            whole = (s for s in starts if s >= 0 and text.startswith(x, s))
            if any(k or not _inside_word(text, s, s + len(x)) for s in whole):
                found[item] = 0
            elif k and found.get(item) != 0:
                for a, b in _merged((s - k, s + len(x) + k) for s in sorted(starts)):
                    if hit := myers(x, text[max(0, a) : b], found.get(item, k)):
                        found[item] = hit[0]
        return found


def _merged(windows: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Sorted windows with those that overlap made one, so that no text is verified twice for an item."""
    begun = None
    for a, b in windows:
        if begun is None:
            begun, last = a, b
        elif a <= last:
            last = max(last, b)
        else:
            yield begun, last
            begun, last = a, b
    if begun is not None:
        yield begun, last


@lru_cache(maxsize=1)
def _items(items: tuple[tuple[int, str], ...]) -> Items:
    """The automaton of a block, built once for all tasks of a worker."""
    return Items(list(items))


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of a bounded size; null ids and texts are left out, repeated rows count once."""
    rows = columns_of(benchmark, item_id="long", text="string").dropna().distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield sorted((r.item_id, normal(r.text)) for r in part.collect())


def contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, edits): one row for each document and item it holds with at most its error budget of edits.

    Null texts hold nothing, and null and blank items are in nothing. An item of
    fewer than CHARS_AN_EDIT characters, which has no edit to spare, counts where it
    stands between word borders. Texts are searched whole, however long, and
    columns other than doc_id and text are left behind.
    Rows that repeat a doc_id report for themselves, and so do equal items.
    """
    docs = columns_of(docs, doc_id="long", text="string")

    def over(items: list[tuple[int, str]]):
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = _items(tuple(items))
            for batch in batches:
                rows = [(d, i, e) for d, x in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) if x for i, e in sorted(known.find(x).items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.int32()))], ["doc_id", "item_id", "edits"])

        return docs.mapInArrow(each, "doc_id long, item_id long, edits int")

    # of several blocks only one at a time is held by the driver and its tasks
    out: list[DataFrame] = []
    for items in blocks(benchmark, block_bytes):
        if out:
            out[-1] = stash(out[-1], "decontaminate-hits")
        out.append(over(items))
    return reduce(DataFrame.unionByName, out)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item; no shuffle."""
    first = True
    for items in blocks(benchmark, block_bytes):

        def each(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            known = _items(tuple(items))
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist()
                yield batch.filter(pa.array(np.array([not (x and known.find(x)) for x in texts], bool)))

        docs = docs if first else stash(docs, "decontaminate-left")
        docs, first = docs.mapInArrow(each, docs.schema), False
    return docs
