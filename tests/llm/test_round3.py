"""Fill-in-the-middle, source divergence and MinHash near-dedup against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import prose

from tracemill.llm import divergence, fim, minhash

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD_TEXTS = ["", "a", "abc", "é", "ab é😀cd", "x" * 7, "x" * 8, "x" * 9, "\n\n", "a1b2c3", "<P>", "a<S>b", "<P", "P>", "end<", "ü" * 9, "A" * 8 + "ü", "a\0b", "@[`{azAZ", "€" * 5 + "word word", "word " * 300]


def test_units_at_every_place():
    """Every rank and select of texts that lie back to back, at every offset in a word."""
    r = random.Random(1)
    texts = [t.encode() for t in ODD_TEXTS + ["".join(r.choice("abZ z9é😀.") for _ in range(r.randrange(40))) for _ in range(60)]]
    bounds = np.cumsum([0, *map(len, texts)])
    marks = fim.Marks(np.frombuffer(b"".join(texts), np.uint8), bounds)
    for a, b, t in zip(bounds, bounds[1:], texts):
        text = t.decode()
        units = UNIT.findall(text)
        base = int(marks.units(np.array([a]))[0])
        assert int(marks.units(np.array([b]))[0]) - base == len(units)
        ends = marks.after(base + np.arange(1, len(units) + 1)) if units else np.array([], int)
        assert ends.tolist() == (a + np.cumsum([len(u.encode()) for u in units])).tolist()
        assert [int(marks.chars(np.array([a + len(text[:k].encode())]))[0] - marks.chars(np.array([a]))[0]) for k in range(len(text) + 1)] == list(range(len(text) + 1))


def plain_fim(doc_id, text) -> tuple:
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def _sorted(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("block", [1, 100, 1 << 22])
def test_fim_of_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK_BYTES", block)
    rows = [(k, t) for k, t in enumerate(ODD_TEXTS * 9)] + [(None, None), (None, "null id"), (7, None), (8, "twice"), (8, "twice")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = fim.rearranged(df).collect()
    assert _sorted(got) == _sorted(plain_fim(*r) for r in rows)


def test_fim_of_the_table_and_odd_rows(spark, documents, odd, empty):
    for df in (documents, odd, empty):
        out = fim.rearranged(df)
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert _sorted(out.collect()) == _sorted(plain_fim(*r) for r in rows)
        back = out.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
        assert _sorted(back) == _sorted((d, t or "") for d, t in rows)


def test_fim_takes_other_shares(spark):
    df = spark.range(300).selectExpr("id as doc_id", "'some words here' as text")
    assert {r.form for r in fim.rearranged(df, plain=100).collect()} == {"plain"} and {r.form for r in fim.rearranged(df, plain=0, spm=100).collect()} == {"spm"}
    assert fim.rearranged(df, seed=2).exceptAll(fim.rearranged(df)).count() > 100


# -- divergence ----------------------------------------------------------------------


def plain_divergence(rows, least=10, top=10) -> list[tuple]:
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = term.findall((text or "").translate(lower))
        docs[lang].update(set(terms))
        count[lang, source].update(terms)
    out = []
    dist = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = sorted(s for l, s in groups if l == lang)
        share = {}
        for s in sources:
            n = sum(count[lang, s][t] for t in kept)
            share[s] = {t: 1 + 1_000_000_000 * (count[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
        whole = {t: sum(count[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 1_000_000_000 * (whole[t] + 2) // (sum(whole.values()) + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted(((-sum(dist(share[s][t], share[o][t]) for t in kept), o) for o in sources if o != s), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "pair", o, -v, k) for k, (v, o) in enumerate(pairs, 1)]
            own = sorted(((-dist(share[s][t], q[t]), t) for t in kept if count[lang, s][t] and share[s][t] > q[t]), key=lambda x: (x[0], x[1].encode()))
            out += [(lang, s, "term", t, -v, k) for k, (v, t) in enumerate(own[:top], 1)]
    return out


@pytest.fixture(scope="module")
def told():
    r = random.Random(4)
    words = [f"{w}{x}" for w in ("Ab", "cd", "éf", "中", "zz") for x in ("", "a", "b", "ß", "X")]
    rows = []
    for k in range(400):
        source = "hot" if k % 3 == 0 else r.choice(["a", "b", "é", None, ""])
        rows.append((" ".join(r.choice(words[: 25 if source == "hot" else 15]) + r.choice(["", ".", "1", "-x"]) for _ in range(r.randrange(30))), r.choice(["en", "de", None]), source))
    return rows + [(None, "en", "only nulls"), ("", "xx", "lonely"), ("few words", "fr", "a"), ("", "fr", "b")] + [("same text again", "en", "b")] * 15


@pytest.mark.parametrize("bits", [64, 2, 1])
def test_divergence_with_and_without_shared_digests(spark, told, bits):
    df = spark.createDataFrame(told, "text string, lang string, source string").repartition(5)
    assert _sorted(divergence.divergences(df, digest_bits=bits).collect()) == _sorted(plain_divergence(told))


def test_divergence_hands_on_what_it_holds(told, monkeypatch):
    texts, langs, sources = ([x or "" for x in c] for c in zip(*told))
    batches = [pa.RecordBatch.from_pydict({"lang": langs[k : k + 50], "source": sources[k : k + 50], "text": texts[k : k + 50]}) for k in range(0, len(told), 50)]

    def summed():
        total, terms, n_rows = Counter(), set(), 0
        for r in (r for b in divergence._counted(iter(batches), 64) for r in b.to_pylist()):
            n_rows += 1
            if r["term"] is None:
                total[r["lang"], r["source"], r["digest"]] += r["n"] + 1_000_000 * r["docs"]
            else:
                terms.add((r["digest"], r["term"]))
        return total, terms, n_rows

    whole = summed()
    for name, most in dict(MERGE=3, HELD=5, KNOWN=7, BATCH=4).items():
        monkeypatch.setattr(divergence, name, most)
    parts = summed()
    assert parts[:2] == whole[:2] and parts[2] > 2 * whole[2]


def test_divergence_of_odd_rows(odd, empty):
    rows = [(r.text, r.lang, r.source) for r in odd.select("text", "lang", "source").collect()]
    assert _sorted(divergence.divergences(odd, least_docs=2).collect()) == _sorted(plain_divergence(rows, 2))
    assert divergence.divergences(empty).count() == 0


# -- MinHash -------------------------------------------------------------------------


def shingle_set(text, k=2) -> frozenset:
    w = [x for x in re.split("[ \t-\r]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))) if x]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def plain_near(rows, percent=80) -> list[tuple]:
    sets = [shingle_set(t) for _, t in rows]
    at = list(range(len(rows)))

    def top(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = top(a), top(b)
                    at[max(x, y)] = min(x, y)
    least = defaultdict(lambda: None)
    for k, (d, _) in enumerate(rows):
        r = top(k)
        if d is not None and (least[r] is None or d < least[r]):
            least[r] = d
    return [(d, len(s), least[top(k)], d is not None and d == least[top(k)]) for k, ((d, _), s) in enumerate(zip(rows, sets))]


def test_sketches_fill_and_estimate():
    r = np.random.RandomState(2)
    for n in (1, 2, 7, 150, 3000):
        assert (minhash.sketch(r.randint(0, 2**62, n).astype(np.uint64)) != ~np.uint64(0)).all()
    agree = []
    for _ in range(60):
        x = r.randint(0, 2**62, 400).astype(np.uint64)
        agree.append((minhash.sketch(x[:300]) == minhash.sketch(x[100:])).mean())
    assert abs(np.mean(agree) - 0.5) < 0.03


def test_common_counts():
    r = np.random.RandomState(3)
    sets = [np.unique(r.randint(0, 9000, n).astype(np.uint64)) for n in (0, 1, 50, 700, 6000, 6000)]
    want = [[len(np.intersect1d(a, b)) for b in sets[2:]] for a in sets]
    assert minhash.common_counts(sets, sets[2:]).tolist() == want


@pytest.fixture(scope="module")
def family():
    """Copies with more and more edits around some texts, chains, and texts that share a passage alone."""
    r = random.Random(9)
    rows = []
    for c in range(4):
        base = prose(70 + 30 * c, 60 + c).split()
        for k in range(45):
            w = list(base)
            for _ in range(r.randrange(0, 14)):
                w[r.randrange(len(w))] = f"edit{r.randrange(50)}"
            rows.append(" ".join(w))
    for k in range(12):  # a chain: each like the next
        rows.append(" ".join(prose(160, 99).split()[4 * k : 4 * k + 60]))
    rows += [f"{prose(60, 500 + k)} {prose(60, 77)}" for k in range(40)]
    rows += ["one", "ONE", "one two", "One  Two", "two one", " \t", "", None] + [prose(50, 5)] * 20
    ids = list(range(len(rows)))
    r.shuffle(ids)
    return list(zip(ids, rows)) + [(None, prose(44, 6)), (None, prose(44, 6)), (3, prose(44, 8)), (3, prose(44, 8))]


@pytest.mark.parametrize("block", [128, 8])
def test_minhash_of_families(spark, family, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    df = spark.createDataFrame(family, "doc_id long, text string").repartition(5)
    assert _sorted(minhash.near_duplicates(df).collect()) == _sorted(plain_near(family))


def test_minhash_of_odd_rows(odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert _sorted(minhash.near_duplicates(odd).collect()) == _sorted(plain_near(rows))
    assert minhash.near_duplicates(empty).count() == 0
