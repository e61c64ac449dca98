"""Main text of web pages by minimum-cut labelling.

A page is cut into text blocks. A classifier's costs and what the markup tells,
both finite, become each block's capacities to the two terminals; neighbours in
the page and blocks of the same container are joined by smoothness edges. The
minimum cut, found by maximum flow, separates content from boilerplate; no
block is settled before it. The classifier sees no markup; it is fitted on
blocks whose markup tells a side.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns_of, hash_sample

#: The classifier is fitted on the blocks of at most so many pages, the lowest by hash.
SAMPLE_PAGES = 300

# Elements of HTML by their role.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option optgroup p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes svg xmp object canvas audio video".split())
BOILER = frozenset("nav aside footer form button select menu dialog head label input search fieldset".split())
CONTENT = frozenset("article main".split())
NAMES = re.compile(r"(?:^|[\s_-])(ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|sidebar|footer|masthead|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommend\w*|comments?|replies|respond|disqus|reviews?|pagination|pager|toolbar|widget|copyright|skip|hidden|alert)(?=$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(comments?|replies|respond|disqus|ads?|advert\w*|sponsor\w*|promo\w*|share|sharing|social|related|newsletter|subscribe|notices?|sidebar|nav\w*|menu\w*|cookies?|hidden)(?=$|[\s_-])", re.I)
TALK = re.compile(r"(?:^|[\s_-])(comments?|replies|respond|disqus|reviews?)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>""")
#: What a tag is once a quote has been left open.
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>")
_OPENS = re.compile(r"<(?=[/!?a-zA-Z])")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_SPACES = re.compile(r"\s+")
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

# Costs, in flow units; the classifier's are at most CLIP * SCALE.
SMOOTH_NEXT, SMOOTH_HOME, SCALE, CLIP = 60, 40, 100, 6
#: What markup is worth, all finite: an article or main around a block (for it); an element of boilerplate or a telling
#: class or id around it (against it, each a little more than the classifier can give, so that only it and the
#: neighbours together outweigh them); a place beside an article that holds all the text (against it).
HOME, MARKED, NAMED, OUTSIDE = 600, 700, 650, 400


class Block:
    __slots__ = ("text", "linked", "home", "depth", "side", "tag", "named")

    def __init__(self, text: str, linked: int, home: int, depth: int, side: int, tag: str, named: int = -1):
        self.text, self.linked, self.home, self.depth, self.side, self.tag, self.named = text, linked, home, depth, side, tag, named


def _tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, lower-case name or "" for comments and declarations, attributes) of each tag, in one pass.

    A quote runs on to its end. Once one is left open up to the end of the page,
    quotes are read no more, so that no part of a page is read over and over.
    """
    at, n, tag = 0, len(page), _TAG
    while m := _OPENS.search(page, at):
        at = m.start()
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            end = n if end < 0 else end + 3
            yield at, end, "", "", ""
        elif found := (tag.match(page, at) or _PLAIN_TAG.match(page, at)):
            if found.re is not tag:
                tag = _PLAIN_TAG
            end = found.end()
            name = found[2].lower()
            yield at, end, found[1], name, found[3]
            if name in RAW and not found[1] and not found[3].rstrip().endswith("/"):
                close = _CLOSE[name].search(page, end)
                end = close.end() if close else n
                yield end, end, "", "", ""
        else:
            end = page.find(">", at) + 1 or n  # a tag without an end runs to the end
            yield at, end, "", "", ""
        at = end


def blocks_of(page: str) -> list[Block]:
    """Text blocks in page order, in time and memory linear in the page. side: 1 inside article or main, -1 inside markup
    of boilerplate, 0 neither. named: the number of the innermost element around it whose class or id tells of boilerplate
    (-1: none). Passed over are those of the page as a whole: around the first main (or article), or around most of the
    text, unless they tell of comments beside or in an article."""
    out: list[Block] = []
    # (tag, side it gives, number of its nearest container, its innermost named element)
    stack: list[tuple[str, int, int, int]] = [("", 0, 0, -1)]
    opened: dict[str, int] = {}  # how often each tag is on the stack
    talks: list[bool] = []  # of each named element, whether it tells of comments
    above: list[int] = []  # and the named element around it
    around: dict[str, int] = {}  # what is named around the first main and article
    parts: list[str] = []
    linked, in_link, count = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                tag, side, home, named = stack[-1]
                out.append(Block(text, linked, home, len(stack), side, tag, named))
            parts.clear()
        linked = 0

    def pop() -> None:
        opened[stack.pop()[0]] -= 1

    at = 0
    for begin, end, slash, name, attributes in (*_tags(page), (len(page), len(page), "", "", "")):
        if begin > at:
            if stack[-1][0] not in RAW:
                piece = page[at:begin]
                parts.append(piece)
                if in_link:
                    linked += len(piece.strip())
        at = end
        if not name:
            if stack[-1][0] in RAW:
                pop()
            continue
        if slash:
            if name == "a":
                in_link = max(0, in_link - 1)
            elif name in BLOCKS:
                flush()
                if opened.get(name):
                    while stack[-1][0] != name:
                        pop()
                    pop()
                    in_link = 0
            continue
        if name in RAW:
            if name in BLOCKS:
                flush()
            if not attributes.rstrip().endswith("/"):
                stack.append((name, *stack[-1][1:]))
                opened[name] = opened.get(name, 0) + 1
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name == "a":
            in_link += 1
            continue
        if name not in BLOCKS:
            continue
        flush()
        if name in VOID:
            continue
        if stack[-1][0] == "p":
            pop()
        implied = _IMPLIED.get(name, ())
        while stack[-1][0] in implied:
            pop()
        side, home, named = stack[-1][1:]
        if name in CONTENT and side >= 0:
            side = 1
            around.setdefault(name, named)
        elif name in BOILER or name == "header" and side != 1:
            side = -1
        if attributes and side >= 0:
            for key, value in _ATTR.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    if name not in ("html", "body") and (COMMENTS if side == 1 else NAMES).search(value):
                        above.append(named)
                        named = len(talks)
                        talks.append(bool(TALK.search(value)))
                elif key == "role" and value.lower() in ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
                    side = -1
        if name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd"):
            count += 1
            home = count
        stack.append((name, side, home, named))
        opened[name] = opened.get(name, 0) + 1
    flush()
    if talks:
        held, total = [0] * len(talks), 0
        for b in out:
            if b.side >= 0:
                total += len(b.text)
                if b.named >= 0:
                    held[b.named] += len(b.text)
        for k in range(len(talks) - 1, -1, -1):  # an element is numbered after the one around it
            if above[k] >= 0:
                held[above[k]] += held[k]
        whole, k = set(), around.get("main", around.get("article", -1))
        while k >= 0:
            whole.add(k)
            k = above[k]
        tells: list[int] = []  # of each named element, itself or the nearest one around it that counts
        for k, talk in enumerate(talks):
            passed = k in whole or 2 * held[k] > total and not (talk and around)
            tells.append(k if not passed else tells[above[k]] if above[k] >= 0 else -1)
        for b in out:
            b.named = tells[b.named] if b.named >= 0 else -1
    return out


def block_features(b: Block) -> tuple[float, ...]:
    """What a block looks like without its markup."""
    text = b.text
    words = text.count(" ") + 1
    stops = sum(text.count(c) for c in ".,;:!?")
    return (1.0, min(math.log1p(words), 6.0), b.linked / max(len(text), 1), min(stops / words, 0.5), float(text[-1] in ".!?…\"”»"), float(words < 4))


#: Weights when the sampled pages have no markup of both kinds: long, unlinked, punctuated text is content.
PRIOR = np.array([-2.0, 0.9, -3.0, 1.0, 0.8, -0.5])


def fit(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> np.ndarray:
    """Logistic weights from blocks whose markup tells their side, on a bounded sample of pages."""
    rows = hash_sample(columns_of(pages, page_id="long", html="string").dropna(), sample_pages, "page_id").select("html").mapInArrow(_seed_batches, "side int, " + ", ".join(f"f{k} double" for k in range(len(PRIOR)))).collect()
    table = np.array(sorted(map(tuple, rows)), float).reshape(-1, len(PRIOR) + 1)
    y, x = (table[:, 0] > 0).astype(float), table[:, 1:]
    if not y.any() or y.all():
        return PRIOR
    w = PRIOR.copy()
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + len(y) * 0.01 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (weight * (y - p)) - len(y) * 0.01 * (w - PRIOR))
    return np.round(w, 9)


def _seed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(-1 if b.named >= 0 else b.side, *block_features(b)) for x in batch.column("html").to_pylist() for b in blocks_of(x) if b.side or b.named >= 0]
        columns = list(zip(*rows)) or [()] * (len(PRIOR) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *[pa.array(c, pa.float64()) for c in columns[1:]]], ["side", *[f"f{k}" for k in range(len(PRIOR))]])


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Whether each node stays on the source's side of a minimum cut. edges: (a, b, capacity both ways)."""
    n = len(source)
    spare = [s - t for s, t in zip(source, sink)]  # what passes straight through is flow already
    to: list[list[int]] = [[] for _ in range(n)]
    head, room = [], []
    for a, b, c in edges:
        to[a].append(len(head))
        head.append(b)
        room.append(c)
        to[b].append(len(head))
        head.append(a)
        room.append(c)
    while True:
        level = [-1] * n
        queue = deque(k for k in range(n) if spare[k] > 0)
        for k in queue:
            level[k] = 0
        ends = False
        while queue:
            a = queue.popleft()
            for e in to[a]:
                b = head[e]
                if room[e] and level[b] < 0:
                    level[b] = level[a] + 1
                    ends = ends or spare[b] < 0
                    queue.append(b)
        if not ends:
            return [x >= 0 for x in level]
        following = [0] * n
        for start in range(n):
            while spare[start] > 0:
                path: list[int] = []
                a = start
                while spare[a] >= 0:
                    while following[a] < len(to[a]):
                        e = to[a][following[a]]
                        if room[e] and level[head[e]] == level[a] + 1:
                            break
                        following[a] += 1
                    else:
                        if not path:
                            break
                        a = head[path.pop() ^ 1]
                        following[a] += 1
                        continue
                    path.append(e)
                    a = head[e]
                if not path:
                    break
                amount = min(spare[start], -spare[a], *(room[e] for e in path))
                for e in path:
                    room[e] -= amount
                    room[e ^ 1] += amount
                spare[start] -= amount
                spare[a] += amount


def capacities(found: list[Block], weights: np.ndarray) -> tuple[list[int], list[int], list[tuple[int, int, int]]]:
    """(to content, to boilerplate, smoothness edges) of a page's blocks."""
    logits = (np.array([block_features(b) for b in found]) @ weights).clip(-CLIP, CLIP)
    inside = sum(len(b.text) for b in found if b.side > 0 and b.named < 0)
    beside = sum(len(b.text) for b in found if b.side == 0 and b.named < 0)
    outside = OUTSIDE * inside // max(inside + beside, 1)  # the more of the text an article holds, the less is beside it
    source, sink, edges, last = [], [], [], {}
    for k, (b, z) in enumerate(zip(found, logits.tolist())):
        cost = int(z * SCALE)
        source.append(max(cost, 0) + (HOME if b.side > 0 and b.named < 0 else 0))
        sink.append(max(-cost, 0) + (MARKED if b.side < 0 else 0) + (NAMED if b.side >= 0 and b.named >= 0 else 0) + (outside if b.side == 0 else 0))
        if k:
            edges.append((k - 1, k, SMOOTH_NEXT // (1 + abs(b.depth - found[k - 1].depth))))
        if (j := last.get(b.home)) is not None:
            edges.append((j, k, SMOOTH_HOME))
        last[b.home] = k
    return source, sink, edges


def extract(page: str | None, weights: np.ndarray) -> str:
    """The main text of one page; empty if there is none."""
    found = blocks_of(page or "")
    return "\n".join(b.text for b, keep in zip(found, min_cut(*capacities(found, weights))) if keep) if found else ""


def extract_pages(pages: DataFrame, weights: np.ndarray) -> DataFrame:
    """One row for each page: page_id, url, text, n_chars. A null or empty page has an empty text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x, weights) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return columns_of(pages, page_id="long", url="string", html="string").mapInArrow(each, "page_id long, url string, text string, n_chars long")
