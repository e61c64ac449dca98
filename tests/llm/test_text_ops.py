"""PII, language, quality, decontamination and HTML against plain Python."""

import hashlib
import html as entities
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from samples import WORDS, prose

from tracemill.llm import decontaminate, html_extract, langid, pii, quality

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

WHO = WORDS[:7]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text) -> list[tuple]:
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), k, m.end(), kind))
    return sorted(out)


def check_pii(rows, texts):
    assert len(rows) == len(texts)
    for r, (doc_id, text) in zip(sorted(rows, key=lambda r: repr((r.doc_id, r.base_sha256))), sorted(texts, key=lambda t: repr((t[0], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in base_spans(t[1])).encode()).hexdigest())))):
        spans = base_spans(text)
        told = [f"{k}:{a}:{b}" for a, _, b, k in spans]
        assert r.doc_id == doc_id and r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        n = Counter(k for *_, k in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in BASE)
        assert set(told) <= set(r.spans.split(",")) | {""} and r.n_added == len([x for x in r.spans.split(",") if x]) - len(told) == r.n_spans - len(told)


def test_pii_on_the_table(documents, texts):
    check_pii(pii.find(documents).collect(), list(texts.items()))


def test_pii_of_odd_rows(spark, odd, empty):
    check_pii(pii.find(odd).collect(), [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert pii.find(empty).count() == 0
    tricky = ["a@b.c_d@e.f", "x@y", "..@a.b-.c", "1.2.3.4.5.6.7.8", "999.1.1.1 1.2.3.04", "4111 1111 1111 1111-4111-1111-1111-1111", "4111111111111111", "+1 (743) 555-3824.", "+12345678901234567", "+1..2", "0" * 3000, "1 " * 4000, "a" * 3000 + "@", "😀 a@b.co 😀 1.1.1.1", "9" * 14 + "." + "9" * 14, "+" * 50 + "1234567890123", "--1--2--", "1.2.3"]
    docs = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string")
    check_pii(pii.find(docs).collect(), list(enumerate(tricky)))


LONG = ["ab at cd{ dot com}", "ab (at) cd{ (dot) com}", "a@b{.c}", "{1.2.3.4.}", "{+1 (555) 123-4567 }", "{4111 1111 1111 1111, }", "{token=}", "{a@}", "{x}@", "{1234567,}", "{12,}", "{a@b.co 10.0.0.1 }"]


def test_pii_of_very_long_texts(spark):
    """Neither recursion nor copies: near-matches a million characters long take time in proportion, and short ones are right."""
    made = lambda form, n: re.sub(r"\{(.*)\}", lambda m: m[1] * (n // len(m[1])), form)
    short = [(k, made(form, 900)) for k, form in enumerate(LONG)]
    check_pii(pii.find(spark.createDataFrame(short, "doc_id long, text string")).collect(), short)
    for k, form in enumerate(LONG):
        began = time.perf_counter()
        text = made(form, 240_000)
        rows = pii.find(spark.createDataFrame([(k, text)], "doc_id long, text string")).collect()
        assert len(rows) == 1 and time.perf_counter() - began < 60, form
        assert rows[0].n_email == {"a@b{.c}": 1, "{a@b.co 10.0.0.1 }": 240_000 // 16}.get(form, 0)
        assert rows[0].n_ip == {"{1.2.3.4.}": 30_000, "{a@b.co 10.0.0.1 }": 240_000 // 16}.get(form, 0)


def test_pii_walks_and_searches(spark):
    d = spark.range(4).selectExpr("transform(sequence(1, cast(id * 700 as int)), k -> cast(k as int)) as a").where("size(a) > 1 or a is null").unionByName(spark.createDataFrame([([],)], "a array<int>"))
    sums = pii._walked("a", "0", "z.at + x", "array_append(z.out, z.at + x)", "int")
    for r in d.selectExpr("a", f"{sums} as s", f"{pii._below('a', '350')} as k").collect():
        assert r.s == list(np.cumsum(r.a)) and r.k == sum(x < 350 for x in r.a)


def test_pii_overlaps_of_many_base_spans_are_those_of_few(spark, monkeypatch):
    texts = [f"mail a{k}@b.co token=ab{k}cd-1234567890abcdef+1{k}5551234567 call 555 123 45{k:02d} 10.0.0.{k % 256} " for k in range(60)]
    docs = spark.createDataFrame([(k, "".join(texts[k : k + 20])) for k in range(40)], "doc_id long, text string")
    told = lambda: sorted((r.doc_id, [(c.s, c.e, c.gen, c.y, c.over) for c in r.cands]) for r in pii._candidates(pii._with_spans(docs)).collect())
    many = told()
    monkeypatch.setattr(pii, "FEW", 10_000)
    assert told() == many and any(c[4] for _, cs in many for c in cs)


def test_pii_adds_secrets_and_no_more(spark):
    """Recall and precision of the added spans on a table that holds keys, tokens and passwords."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told, got = set(), set()
    for r in docs.select("doc_id", "text").collect():
        for m in re.finditer(r'token = "([0-9a-f]{40})"|password=([0-9a-f]{18})|\b(AKIA[A-Z0-9]{16})\b', r.text or ""):
            told.add((r.doc_id, f"secret:{m.start(m.lastindex)}:{m.end(m.lastindex)}"))
    for r in pii.find(docs).collect():
        spans = {x for x in r.spans.split(",") if x}
        got |= {(r.doc_id, x) for x in spans if x.startswith("secret:")}
        assert r.n_spans == len(spans)
    assert len(told) > 10 and len(told & got) >= 0.95 * len(told) and len(told & got) >= 0.95 * len(got)


def test_pii_trees_carry_formats_over(spark):
    """What context names teaches formats, by which the trees add spans of several kinds where nothing names them; held-out calibration keeps plain numbers out."""
    r = random.Random(9)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    key = lambda: "AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    rows, told = [], {}
    for k in range(600):
        words, kind = re.sub("[0-9]", "", prose(12, k)), k % 6
        value = [f"({number(3)}) {number(3)}-{number(4)}", f"{WHO[k % 7]} [at] {WHO[k % 5]} [dot] org", key(), f"{number(9)}", "plain", "".join(r.choice("0123456789abcdef") for _ in range(32))][kind]
        named = k // 6 % 3 > 0
        lead = ["phone: ", "mail: ", "", "part ", "", "secret = "][kind] if named else ["", "", "", "part ", "", ""][kind]
        rows.append((k, f"{words} {lead}{value} end"))
        told[k] = (kind, len(words) + 1 + len(lead), value)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {x.doc_id: [s for s in x.spans.split(",") if s] for x in pii.find(docs).collect()}
    hit = Counter()
    for k, (kind, at, value) in told.items():
        hit[kind] += any(s.endswith(f":{at}:{at + len(value)}") for s in found[k])
    assert hit[0] >= 95 and hit[1] >= 95 and hit[2] >= 95 and hit[5] >= 90, hit
    assert sum(len(found[k]) for k, t in told.items() if t[0] == 4) == 0 and hit[3] <= 5, hit
    assert {s.split(":")[0] for x in found.values() for s in x} >= {"phone", "email", "secret"}


def test_pii_keeps_no_text_outside_the_tables(spark):
    docs = spark.createDataFrame([(1, "mail some.body@mail.example.com, +1 (743) 555-3824")], "doc_id long, text string")
    rows = pii._candidates(pii._with_spans(docs))
    assert "some.body" not in str(rows.collect()) and "string" not in rows.drop("doc_id").schema.simpleString()


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co or 1.1.1.1!", "x"), (1, "second a@b.co", "y"), (1, "second a@b.co", "z"), (2, None, None), (3, "none", "x"), (None, "1.2.3.4", "x")], "doc_id long, text string, p string").withColumn("row", F.lit("clash")).withColumn("of", F.lit("clash"))
    got = pii.redact(docs)
    assert got.columns == docs.columns
    assert sorted((r.p or "", r.text or "", r.row, r.of) for r in got.collect()) == [("", "", "clash", "clash"), ("x", "[ip]", "clash", "clash"), ("x", "mail [email] or [ip]!", "clash", "clash"), ("x", "none", "clash", "clash"), ("y", "second [email]", "clash", "clash"), ("z", "second [email]", "clash", "clash")]


def test_boosting_follows_its_labels():
    rng = np.random.RandomState(2)
    x = rng.randint(0, 5, (400, len(pii.FEATURES)))
    x[:, 0] = rng.randint(0, 3, 400)
    y = ((x[:, 1] >= 3) ^ (x[:, 2] >= 4)).astype(float)
    m = pii.Boosted(x, y, np.ones(400), np.arange(400) % 5, np.ones(400) > 0)
    assert len(m.trees) == pii.TREES and any(np.isfinite(v) for v in m.cut.values())
    assert all(v == np.inf for v in pii.Boosted(x, y, np.ones(400), np.arange(400) % 5, np.zeros(400) > 0).cut.values())
    assert pii.Boosted(x[:0], y[:0], y[:0], y[:0], y[:0] > 0).lets("c") == "false"


def test_pii_fit_uses_every_combination(spark, monkeypatch):
    """However few combinations the driver takes, trees and thresholds are those of all candidates, one by one."""
    r = random.Random(4)
    form = lambda: "".join(r.choice("abcXYZ0123456789"[r.randrange(3) * 3 :]) for _ in range(r.randint(16, 40)))
    docs = spark.createDataFrame([(k, " ".join(r.choice(["token=", "key ", "", "phone: "]) + r.choice([form(), f"{r.randrange(10**9)}", f"555 {r.randrange(10**6)}-{r.randrange(10**4)}"]) for _ in range(20))) for k in range(60)], "doc_id long, text string")
    cands = pii._candidates(pii._with_spans(docs)).localCheckpoint()
    monkeypatch.setattr(pii, "TREES", 4)
    monkeypatch.setattr(pii, "COMBINATIONS", 20)
    few = pii.fit(cands)
    rows = cands.select(F.pmod(F.xxhash64("doc_id"), F.lit(pii.FOLDS)).alias("fold"), F.explode("cands").alias("c")).select("fold", "c.*").collect()
    x, y, fold, free = (np.array([f(q) for q in rows]) for f in (lambda q: [q[n] for n in pii.FEATURES], lambda q: q.y, lambda q: q.fold, lambda q: not q.over))
    one_by_one = pii.Boosted(x, y.astype(float), np.ones(len(x)), fold, free)
    assert len({tuple(v) for v in x}) > 100 and any(np.isfinite(v) for v in few.cut.values())
    monkeypatch.setattr(pii, "COMBINATIONS", 10**6)
    for other in (pii.fit(cands), one_by_one):
        assert (few.start, few.trees, few.cut) == (other.start, other.trees, other.cut)


def test_language_held_out(spark):
    r = random.Random(3)
    alphabets = {"xx": "abcdefg", "yy": "mnopqrs", "zz": "äöüßéèà"}
    rows = [(k, " ".join("".join(r.choice(a) for _ in range(r.randint(2, 8))) for _ in range(r.randint(3, 200))), lang) for k, (lang, a) in enumerate(list(alphabets.items()) * 120)]
    docs = spark.createDataFrame(rows + [(5000, None, "xx"), (5001, " 12 !", None), (5002, "", "xx")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    net = langid.fit(docs)
    got = langid.identify(docs, net).collect()
    truth = {k: lang for k, _, lang in rows}
    out = [g for g in got if g.doc_id < 5000 and g.held_out]
    assert len(out) > 80 and np.mean([g.lang_pred == truth[g.doc_id] for g in out]) > 0.97
    assert [(g.lang_pred, g.score) for g in got if g.doc_id >= 5000] == [("und", 0.0)] * 3
    assert all(0 <= g.score <= 1 for g in got)


def test_language_of_the_table_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in langid.identify(docs, langid.fit(docs)).collect()}
    told = [(got[r.doc_id].lang_pred == r.lang, len(r.text)) for r in docs.collect() if r.lang and got[r.doc_id].held_out and got[r.doc_id].lang_pred != "und"]
    assert len(told) > 200 and np.mean([x for x, _ in told]) >= 0.97
    assert np.mean([x for x, n in told if n > 200]) >= 0.98


def test_every_language_is_learned(spark):
    """Ninety languages, most of them rare; and letters are those of any script, but no fraction or numeral."""
    rows = [(k, chr(0x4E00 + 40 * (k % 90) + k % 7) * 12, f"l{k % 90:02d}") for k in range(900)] + [(9000, "\u00bd \u00b2 \u2167 \u2460 12", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.fit(docs)
    assert len(net.langs) == 90 + bool([1 for r in langid.identify(docs.where("doc_id = 9000"), net).collect() if not r.held_out])
    assert langid.identify(docs.where("doc_id = 9000"), net).first().lang_pred == "und"
    assert not langid.has_letter("\u00bd \u00b2 \u2167 \u2460 _ 7") and langid.has_letter("7\u00e9") and langid.has_letter("\u4e00")


def test_language_learns_from_nothing(empty, odd):
    net = langid.fit(empty)
    assert {r.lang_pred for r in langid.identify(odd, net).collect()} == {"und"}
    assert langid.identify(empty, net).count() == 0
    assert langid.identify(odd, langid.fit(odd)).count() == odd.count()


def test_gradients_agree_with_differences():
    net = langid.Net(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.RandomState(4)
    codes, lang = rng.randint(0, 257, (6, 5)), rng.randint(0, 3, 5)

    def loss():
        both = np.concatenate([net.states(codes, 0), net.states(codes, 1)], axis=1).astype(np.float64)
        y = net.probabilities(both.transpose(1, 0, 2).reshape(16, -1))
        real = (codes != 256).reshape(-1)
        return -(np.log(y[np.tile(lang, 6), np.arange(30)]) * real).sum() / real.sum()

    g = net.gradients(codes, lang)
    for name in net.p:
        for _ in range(6):
            at = tuple(rng.randint(0, n) for n in net.p[name].shape)
            if name == "x":
                at = (at[0], at[1], int(codes.flat[rng.randint(30)]))
            keep = net.p[name][at]
            net.p[name][at] = keep + 1e-3
            up = loss()
            net.p[name][at] = keep - 1e-3
            down = loss()
            net.p[name][at] = keep
            assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3


def plain_counts(text) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    five = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = set()
    for i in range(len(words) - 4):
        if five[tuple(words[i : i + 5])] > 1:
            again.update(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab #\n\té\x0b😀", max_size=200))
def test_rule_counts(text):
    assert quality.rule_counts(text.encode())[:5] == plain_counts(text)


def test_rule_counts_of_many_words():
    words = [f"w{k}" for k in range(7000)] + [f"w{k}" for k in range(100, 140)]
    assert quality.rule_counts(" ".join(words).encode())[4] == 80


def test_quality_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.01"  # 400 labelled rows; at the smallest size only 80
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in documents.select("doc_id", "text").collect()}
    verdict = quality.fit(documents, labels)
    rows = {r.doc_id: r for r in quality.judge(documents, verdict).collect()}
    for d, t in texts.items():
        r, want = rows[d], plain_counts(t)
        assert tuple(r[c] for c in quality.BASE) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r.base_failed and r.kept)
    marked = [(r.quality, rows[r.doc_id]) for r in labels.collect()]
    good = [r.kept for q, r in marked if q == 1 and not r.base_failed]
    bad = [r.kept for q, r in marked if q == 0 and not r.base_failed]
    assert np.mean(good) > 0.97 and (not bad or np.mean(bad) < 0.5)
    kept = quality.filter_quality(documents, verdict)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {d for d, r in rows.items() if r.kept}


def test_quality_of_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    verdict = quality.fit(odd, none)
    rows = quality.judge(odd, verdict).collect()
    assert len(rows) == odd.count() and {r.doc_id: r.kept for r in rows} == {1: False, 2: False, 3: False, 4: False, 5: True, 6: True, 7: True, None: True, 8: True, 9: False}
    assert quality.judge(empty, verdict).count() == quality.filter_quality(empty, verdict).count() == 0
    assert quality.filter_quality(odd, verdict).columns == odd.columns
    some = spark.createDataFrame([(1, 0, None), (None, 1, 0), (6, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(odd, quality.fit(odd, some)).count() == odd.count()


def test_quality_on_held_out_labels(spark):
    """Fitted on two thirds of the labels, measured on the others."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    own = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    verdict = quality.fit(docs, labels.where(~own))
    rows = quality.judge(docs.join(labels.where(own), "doc_id", "left_semi"), verdict).join(labels, "doc_id").select("quality", "kept", "base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    bad = [r.kept for r in rows if r.quality == 0]
    assert len(good) > 500 and np.mean(good) > 0.97 and np.mean(bad) < 0.2


def test_quality_of_rows_that_repeat_ids(spark):
    docs = spark.createDataFrame([(1, prose(50, 1))] * 300 + [(k, prose(50, k)) for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(1, 40)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, quality.fit(docs, labels)).count() == 338


def test_forest_isolates_what_is_far():
    rows = np.random.RandomState(0).normal(0, 1, (500, 3))
    forest = quality.IsolationForest(rows)
    assert forest.score(np.array([[8.0, 8, 8]]))[0] > forest.score(rows).max()
    assert len(forest.score(rows[:0])) == 0


def edit_distance_within(p: str, t: str) -> int:
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        before, row = row, [i]
        for j, b in enumerate(t, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (a != b)))
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=30))
def test_myers(p, t):
    got = decontaminate.myers(p, t, len(p))
    assert (got[0] if got else len(p)) == edit_distance_within(p, t)


def test_decontamination_finds_edited_copies(spark):
    items = [(k, prose(30, 1000 + k)) for k in range(8)] + [(90, None), (91, ""), (92, "tiny"), (None, prose(30, 1))]
    bench = spark.createDataFrame(items + items[:1], "item_id long, text string").withColumn("edits", F.lit(0))
    docs, want = [], set()
    for k, x in items[:8]:
        y = list(x)
        for e in range(len(x) // decontaminate.CHARS_AN_EDIT if k % 2 else 0):
            y[e * decontaminate.CHARS_AN_EDIT + 3] = "#"
        docs.append((k, f"{prose(50, k)}\n {''.join(y).upper().replace(' ', '  ')} {prose(50, 50 + k)}"))
        want.add((k, k))
    broken = "".join("#" if i % 9 == 0 else c for i, c in enumerate(items[0][1]))
    docs += [(20, prose(200, 77)), (21, broken), (22, None), (23, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    got = decontaminate.contaminated(df, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and {r.edits for r in got if r.doc_id % 2 == 0} == {0}
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench, 400).collect()} == want
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df, bench).collect()) == [20, 21, 22, 23]
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0 and decontaminate.drop_contaminated(df, bench.limit(0)).count() == df.count()


def test_items_without_a_spare_edit_match_between_word_borders(spark):
    """Fewer than 16 characters: no edit, and no word goes on across the ends; 16 and more: one edit for 16, anywhere."""
    bench = spark.createDataFrame([(1, "The answer is forty"), (2, "42"), (3, " \n"), (4, None), (5, "answer is forty")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "so  THE answer\nis forty."), (2, "the answer is fortyish 142 and 421"), (3, "it was 42, or so"), (4, None), (5, ""), (6, "the answer is forti"), (3, "it was 42, or so"), (None, "42"), (7, "an answer was forty")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.edits) for r in decontaminate.contaminated(docs, bench).collect())
    assert got == [(0, 2, 0), (1, 1, 0), (1, 5, 0), (2, 1, 0), (3, 2, 0), (3, 2, 0), (6, 1, 1)]
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()) == [4, 5, 7]
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_equals_all_pairs():
    """Items with edits of every kind, planted or broken, against edit distances of every item in every text."""
    r = random.Random(4)
    items = [(k, decontaminate.normal(prose(r.randint(4, 12), 500 + k))) for k in range(12)]
    known = decontaminate.Items(items)
    for n in range(60):
        _, x = r.choice(items)
        y = list(x)
        for _ in range(r.randint(0, len(x) // decontaminate.CHARS_AN_EDIT + 2)):
            at = r.randrange(len(y))
            y[at : at + 1] = r.choice([[], ["#"], [y[at], "z"]])
        text = f"{prose(15, n)} {''.join(y)} {prose(15, 90 + n)}" if n % 3 else "".join(y)
        text = decontaminate.normal(text)
        want = {}
        for i, z in items:
            d = edit_distance_within(z, text)
            if d <= len(z) // decontaminate.CHARS_AN_EDIT:
                want[i] = d
        assert known.find(text) == want


def test_a_frequent_piece_is_verified_once():
    x = "one two three four five six seven eight nine ten"
    known = decontaminate.Items([(1, x)])
    began = time.perf_counter()
    assert known.find("one two three four " * 20_000) == {}
    assert known.find("one two three four " * 20_000 + x) == {1: 0}
    assert time.perf_counter() - began < 8


def test_decontamination_on_the_table(spark, documents, texts, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    bench, want = bench.collect(), set()
    for d, t in texts.items():
        t = decontaminate.normal(t)
        want |= {(d, b.item_id) for b in bench if decontaminate.myers(x := decontaminate.normal(b.text), t, len(x) // decontaminate.CHARS_AN_EDIT)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert got == want and want  # every pair, by edit distance over the whole text


def test_pages_on_the_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract_pages(pages, html_extract.fit(pages)).collect()}
    for r in pages.collect():
        body = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]+>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>|<br>(?=<p>)", body))
        want = "\n".join(x for x in parts if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


PAGE = """<html><head><title>T</title><script>if (a<b) document.write("</p>")</script></head><body><header>Site name</header>
<div class="top-menu"><a href=/a>Home</a> <a href=/b>News</a></div><div id="cookie-notice">We use cookies. Accept?</div>
<div class=story><h1>A title &amp; more</h1><p>The first   paragraph is long enough, it has commas, and it ends with a stop.
<p>The second one is long too, with <b>bold</b> words &mdash; and an entity; it says something real.<ul><li>one point that matters in this story, a bit long.</li></ul></div>
<aside>Related: <a href=/c>other story</a></aside><div class="comments"><p>Reader: I liked this story a lot, thanks for it, it was great.</p></div>
<form><input name=q><button>Search</button></form><footer>&copy; 2024</footer></body>"""


def test_page_without_article():
    got = html_extract.extract(PAGE, html_extract.PRIOR)
    assert got == "A title & more\nThe first paragraph is long enough, it has commas, and it ends with a stop.\nThe second one is long too, with bold words — and an entity; it says something real.\none point that matters in this story, a bit long."


def test_the_cut_decides(spark, sf_dir):
    """Without article elements the text is still found; by cuts that neither a block's own costs nor its markup give."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    weights = html_extract.fit(pages)
    kept = total = extra = by_cut = by_markup = 0
    for r in pages.collect():
        want = set(html_extract.extract(r.html, weights).split("\n"))
        page = re.sub("<(/?)article", r"<\1div", r.html)
        got = html_extract.extract(page, weights).split("\n")
        total += sum(map(len, want))
        kept += sum(len(x) for x in want & set(got))
        extra += sum(len(x) for x in got if x not in want)
        found = html_extract.blocks_of(page)
        source, sink, edges = html_extract.capacities(found, weights)
        cut = html_extract.min_cut(source, sink, edges)
        by_cut += cut != [a > b for a, b in zip(source, sink)]
        by_markup += cut != [b.side > 0 for b in found]
    assert kept >= 0.95 * total and extra <= 0.02 * total and by_cut > 0 and by_markup > 0


def test_no_element_settles_a_block():
    """Each piece of markup costs something finite, and less than the classifier and the neighbours can give."""
    most = html_extract.CLIP * html_extract.SCALE
    around = 2 * (html_extract.SMOOTH_NEXT + html_extract.SMOOTH_HOME)
    for x in (html_extract.HOME, html_extract.MARKED, html_extract.NAMED, html_extract.OUTSIDE):
        assert 0 < x < most + around


def test_pages_in_linear_time():
    for page in ('<a href="x' * 100_000, "<div>" * 100_000 + "x" + "</p>" * 100_000, '<div class="ad">' * 30_000 + "x", "<!--" * 100_000, "<x" * 100_000):
        began = time.perf_counter()
        html_extract.extract(page, html_extract.PRIOR)
        assert time.perf_counter() - began < 4
    long = "<article>" + "<p>Some text, and more of it, that goes on. " * 50_000 + "</article>"
    assert html_extract.extract(long, html_extract.PRIOR).count("\n") == 49_999
    assert html_extract.extract('<article><p title="a>b" class=c>One sentence, long enough to stay.<p>5 < 6 and "so" on, it\'s true.</article>', html_extract.PRIOR) == 'One sentence, long enough to stay.\n5 < 6 and "so" on, it\'s true.'


def test_pages_of_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "plain text only, without any markup at all, but long enough to be content."), (4, "u", "<p>" * 3000), (None, "u", "<article><p>a &lt;b&gt; c</article>"), (5, "u", '<a href="x' * 300), (6, "u", "<!-- open"), (7, "u", "<script>var a"), (8, "u", "<article><p>twice</article>"), (8, "u", "<article><p>twice</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    found = html_extract.extract_pages(pages, html_extract.fit(pages)).collect()
    got = {r.page_id: r.text for r in found}
    assert len(found) == len(rows) and [r.text for r in found if r.page_id == 8] == ["twice", "twice"]
    assert got[1] == got[2] == got[4] == got[6] == got[7] == "" and got[None] == "a <b> c" and got[3].startswith("plain text")
    assert html_extract.extract_pages(pages.limit(0), html_extract.fit(pages.limit(0))).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 7).flatmap(lambda n: st.tuples(st.lists(st.integers(0, 9), min_size=n, max_size=n), st.lists(st.integers(0, 9), min_size=n, max_size=n), st.lists(st.tuples(st.integers(0, n - 1), st.integers(0, n - 1), st.integers(0, 9)), max_size=12))))
def test_min_cut_is_minimal(problem):
    source, sink, edges = problem
    edges = [e for e in edges if e[0] != e[1]]

    def cost(side):
        return sum(t if s else a for s, a, t in zip(side, source, sink)) + sum(c for a, b, c in edges if side[a] != side[b])

    n = len(source)
    best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
    assert cost(html_extract.min_cut(source, sink, edges)) == best


def test_names_and_articles_do_not_settle_a_page():
    """Wrappers named after a sidebar hold the page's text; a story beside teaser cards competes; what is named and small still goes."""
    story = "".join(f"<p>{(' '.join(['The council said on day', str(k), 'that the bridge, long closed, would open again in spring']) + '. ') * 4}</p>" for k in range(6))
    plain = lambda page: html_extract.extract(page, html_extract.PRIOR)
    ad = '<div class="ad">Buy one now, get two.</div>'
    for page in (f'<body class="has-sidebar"><article>{story}</article>{ad}</body>', f'<body><div class="page with-sidebar"><article>{story}</article>{ad}</div></body>', f'<body><div id="content" class="no-widget">{story}</div>{ad}</body>'):
        got = plain(page)
        assert got.count("The council") == 24 and "Buy one" not in got
    cards = "".join(f"<article><h2>Card {k}</h2></article>" for k in range(4))
    assert plain(f"<body><div>{story}</div>{cards}</body>").count("The council") == 24
    talk = '<div class="comments"><article class="comment"><p>Nice read, thanks.</p></article></div>'
    assert "Nice read" not in plain(f"<body><article>{story}</article>{talk}</body>")
