"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A logistic classifier over a block's length, links, punctuation, kind, and
the elements and names around it gives each block the cost of calling it content or boilerplate, which
become the capacities of its edges to the two terminals; neighbours in page order and blocks of one parent
element are tied by edges that cost when they are labelled apart. The maximum flow's minimum cut separates
content from boilerplate for the page as a whole. The classifier's weights are drawn towards 0 and learnt on a
bounded sample of pages (SAMPLE, and LEARNT blocks of each) whose own elements (article, main) serve as labels.
Every page is seen once as it is, twice with what its elements say left out, and REDRAWN times with its parts
under other elements and names: the article under an article's or none, the rest and copies of paragraphs
under those of boilerplate, inside the article or beside it. Without a page that has labels, FALLBACK is used.

What no text can be never becomes a block: the head, scripts, styles, forms' controls, pictures and what
stands in for media; such elements and all inline ones don't end a block. Inside a block white space becomes
one space, character references are decoded, a line break is white space; blocks are joined in page order by
one line feed. Null or empty html gives an empty text, as does a page without blocks. Pages with the same id
are independent rows, equal pages get equal texts and count once in learning; pages with equal hashes are
learnt from in no order that matters. An empty table gives no rows. Other columns are passed over. Reading a
page takes time in proportion to its length, however its elements are nested or left open.
"""

from __future__ import annotations

import html
import math
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.arrow import map_batches

#: Most pages that the classifier learns from, most blocks of a page, evenly spaced, and how often each is redrawn.
SAMPLE, LEARNT, REDRAWN = 2_000, 200, 4
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# fixed values: headings over readers' comments; words that an article may use as well need a number beside them
_COMMENTS = r"(?:comments?|kommentare?|commentaires?|comentarios?)"
_REPLIES = r"(?:comments?|repl(?:y|ies)|responses?|kommentare?|antwort(?:en)?|commentaires?|réponses?|comentarios?|respuestas?)"
_OPENS_REPLIES = re.compile(rf"^\W*(?:\d+\s+{_REPLIES}|{_REPLIES}\s*\W?\d+|{_COMMENTS})\W*$", re.I)
_IMPRINT = re.compile(r"(?:©|\(c\)|copyright\b|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos)", re.I)

# fixed values: elements, and names of elements, by what they say of a block
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title".split())
_SKIPPED = _RAW | frozenset("head noscript template select button svg iframe object canvas audio video datalist".split())
_SHUTS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
_CLOSES_P = _BLOCKS - {"html", "body"}
_GOOD_NAMES = frozenset("article articlebody article-body body content entry entry-content hentry main main-content maincontent post post-body post-content postbody story story-body text".split())
_AD_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense ad-banner ad-slot promo promoted sponsor sponsored".split())
_REPLY_NAMES = frozenset("comment comments commentlist comment-list comments-area discussion disqus disqus_thread feedback reactions replies respond responses thread".split())
_NOTICE_NAMES = frozenset("consent cookie cookies gdpr login modal newsletter notification paywall popup sidebar signup subscribe subscription".split())
_BAD_NAMES = frozenset("banner breadcrumb breadcrumbs button contentinfo copyright disclaimer footer form header masthead menu nav navbar navigation notice pager pagination popular recommended related reply search share sharing skip social tags toolbar widget".split())
#: What the elements around a block say, one bit each.
_ELEMENTS = ("article", "nav", "header", "footer", "aside", "form", "dialog", "good_name", "bad_name", "bad_part", "ad_name", "notice_name", "replies")
_BIT = {n: 1 << i for i, n in enumerate(_ELEMENTS)}
_TAG_BIT = {"article": "article", "main": "article", "nav": "nav", "menu": "nav", "footer": "footer", "aside": "aside", "form": "form", "dialog": "dialog"}


def _says(tag: str, attributes: str, around: int) -> int:
    """The bits of an element inside others: a header inside an article is the article's own."""
    bits = around
    if tag in _TAG_BIT:
        bits |= _BIT[_TAG_BIT[tag]]
    elif tag == "header" and not around & _BIT["article"]:
        bits |= _BIT["header"]
    if "=" in attributes and tag not in ("html", "body"):
        for name in " ".join("".join(x) for x in _NAMES.findall(attributes)).lower().split():
            if name in _AD_NAMES:
                bits |= _BIT["ad_name"]
            elif name in _REPLY_NAMES:
                bits |= _BIT["replies"]
            elif name in _NOTICE_NAMES:
                bits |= _BIT["notice_name"]
            elif name in _BAD_NAMES:
                bits |= _BIT["bad_name"]
            elif name in _GOOD_NAMES:
                bits |= _BIT["good_name"]
            elif not _NOTICE_NAMES.isdisjoint(parts := re.split(r"[-_]", name)):
                bits |= _BIT["notice_name"]
            elif not _BAD_NAMES.isdisjoint(parts) or not _AD_NAMES.isdisjoint(parts):
                bits |= _BIT["bad_part"]
            elif not _REPLY_NAMES.isdisjoint(parts):
                bits |= _BIT["replies"]
    return bits


class Block:
    __slots__ = ("text", "linked", "tag", "parent", "bits")

    def __init__(self, text: str, linked: float, tag: str, parent: int, bits: int):
        self.text, self.linked, self.tag, self.parent, self.bits = text, linked, tag, parent, bits


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # element, its number, what it and those around it say
    opened: dict[str, list[int]] = defaultdict(list)  # where elements of a name are in the stack
    unclosed: set[str] = set()  # skipped elements that end nowhere below
    text: list[str] = []
    linked, in_a, n = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join("".join(text).split())
            if joined:
                tag, _, bits = stack[-1] if stack else ("", 0, 0)
                out.append(Block(joined, min(1.0, linked / len(joined)), tag, stack[-2][1] if len(stack) > 1 else 0, bits))
            text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            text.append(raw)
            if in_a:
                linked += len(raw.strip())

    def close(tag: str, until: tuple[str, ...] = ()) -> None:
        if opened[tag] and all(not opened[x] or opened[x][-1] < opened[tag][-1] for x in until):
            flush()
            least = opened[tag][-1]
            while len(stack) > least:
                opened[stack.pop()[0]].pop()

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            cut_off = page.rfind("<", at)  # a tag that the page's end cuts off
            add(page[at : cut_off if cut_off >= 0 and re.match(r"<[a-zA-Z/!]", page[cut_off:]) else size])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closed = m[3].rstrip().endswith("/")
        if m[1]:
            if tag == "a":
                in_a = False
            elif tag in _BLOCKS:
                close(tag)
        elif tag in _SKIPPED:
            if closed and tag not in _RAW:
                continue
            end = None if tag in unclosed else re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None:
                unclosed.add(tag)
            at = end.end() if end else size if tag in _RAW else at
        elif tag == "a":
            in_a = True
        elif tag in ("br", "img", "wbr", "input"):
            text.append("" if tag == "wbr" else " ")
        elif tag in _BLOCKS:
            flush()
            if tag in _CLOSES_P:
                close("p", ("td", "th", "div", "article", "section", "li", "blockquote"))
            for other in _SHUTS.get(tag, ()):
                close(other, ("ul", "ol", "dl", "table"))
            in_a = False
            if tag not in _VOID and not closed:
                n += 1
                opened[tag].append(len(stack))
                stack.append((tag, n, _says(tag, m[3], stack[-1][2] if stack else 0)))
    flush()
    return out


#: Features of a block: the text's own, then what its elements say, then that another part of the page is an article's, that its element opens with a heading of replies, and that it is an imprint outside articles.
_OWN = ("one", "words", "linked", "marks", "p", "heading", "li", "loose")
_NAMES_OF = (*_OWN, *_ELEMENTS, "elsewhere", "below_replies", "imprint")
_AT = {n: i for i, n in enumerate(_NAMES_OF)}
_KINDS = [_AT[n] for n in ("p", "heading", "li", "loose")]
_HIDDEN = [_AT[n] for n in (*_ELEMENTS, "elsewhere", "below_replies")]
#: Weights where no page of the sample has labels: long texts and headings without links are content.
FALLBACK = np.array([{"one": -3.0, "words": 1.5, "linked": -6.0, "heading": 2.0}.get(n, 0.0) for n in _NAMES_OF])

#: How strongly learning is drawn towards 0, for each example.
DRAW = 0.001


def features(own: list[Block]) -> np.ndarray:
    """One row of features for each block of a page."""
    out = np.zeros((len(own), len(_NAMES_OF)))
    some = any(b.bits & _BIT["article"] for b in own)
    seen: dict[int, bool] = {}
    for i, b in enumerate(own):
        n = b.text.count(" ") + 1
        heading = b.tag[:1] == "h" and b.tag[1:].isdigit()
        if b.parent not in seen:
            seen[b.parent] = len(b.text) < 40 and bool(_OPENS_REPLIES.match(b.text))
        bits = [float(bool(b.bits & _BIT[x])) for x in _ELEMENTS]
        out[i] = [1.0, math.log1p(n), b.linked, min(1.0, sum(b.text.count(c) for c in ".,;:!?") / n), b.tag == "p", heading, b.tag == "li", not heading and b.tag not in ("p", "li"), *bits, some and not bits[0], seen[b.parent], not bits[0] and bool(_IMPRINT.match(b.text))]
    return out


def learn(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, drawn towards 0."""
    if len(y) == 0 or y.min() == y.max():
        return FALLBACK
    w = np.zeros(x.shape[1])
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    draw = DRAW * len(y)
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + draw * np.eye(len(w))
        w -= np.clip(np.linalg.solve(h, x.T @ (weight * (p - y)) + draw * w), -1, 1)
    return w


def cut(bias: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: node i pays max(0, bias) if False, max(0, -bias) if True, ties pay if their ends differ.

    Nodes whose bias outweighs all their ties are settled at once; the others' minimum cut comes from the
    maximum flow along shortest augmenting paths.
    """
    n = len(bias)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in ties:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    bias, label = list(bias), [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(bias[i]) >= sum(near[i].values()):
            label[i] = bias[i] > 0
            for j, w in near[i].items():
                bias[j] += w if label[i] else -w
                del near[j][i]
                todo.append(j)
            near[i] = {}
    seen: set[int] = set()
    for first in range(n):
        if label[first] is None and first not in seen:
            part, todo = [first], [first]
            seen.add(first)
            while todo:
                for j in near[todo.pop()]:
                    if j not in seen:
                        seen.add(j)
                        part.append(j)
                        todo.append(j)
            kept = _source_side(part, bias, near)
            for i in part:
                label[i] = i in kept
    return label


def _source_side(part: list[int], bias: list[float], near: list[dict[int, float]]) -> set[int]:
    """The source's side of a minimum cut of one connected part: a flow that blocks all shortest paths, until none is left."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in part} | {source: {}, sink: {}}
    for i in part:
        a, b = (source, i) if bias[i] > 0 else (i, sink)
        room[a][b], room[b][a] = abs(bias[i]), 0.0
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            i = queue.popleft()
            for j, c in room[i].items():
                if c > 1e-12 and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if sink not in level:
            return set(level)
        ahead = {i: [j for j in room[i] if level.get(j) == k + 1] for i, k in level.items()}
        path = [source]
        while path:
            i = path[-1]
            if i == sink:
                least = min(room[a][b] for a, b in zip(path, path[1:]))
                for a, b in zip(path, path[1:]):
                    room[a][b] -= least
                    room[b][a] += least
                path = path[:1]
            elif ahead[i] and room[i][ahead[i][-1]] > 1e-12:
                path.append(ahead[i][-1])
            elif ahead[i]:
                ahead[i].pop()
            else:
                path.pop()
                if path:
                    ahead[path[-1]].pop()


#: Most that a block's own features weigh, and the strengths of ties in page order and of ties of one parent.
MOST, ORDER, SIBLING = 6.0, 0.7, 1.0


def costs(own: list[Block], w: np.ndarray) -> tuple[list[float], list[tuple[int, int, float]]]:
    """What each block costs if it isn't content (less than 0: if it is), and the ties."""
    bias = np.clip(features(own) @ w, -MOST, MOST).tolist()
    ties, before = [], {}
    for i, b in enumerate(own):
        if i:
            ties.append((i - 1, i, ORDER * (1.0 if own[i - 1].parent == b.parent else 0.5)))
        if before.get(b.parent, i - 1) < i - 1:
            ties.append((before[b.parent], i, SIBLING))
        before[b.parent] = i
    return bias, ties


def main_text(page: str | None, w: np.ndarray) -> str:
    own = blocks(page) if page else []
    if not own:
        return ""
    return "\n".join(b.text for b, keep in zip(own, cut(*costs(own, w))) if keep)


#: What stands around content, and around the rest, on pages that name their parts differently; prose stands under PROSE, too, and is no content there.
CONTENT = (("article",), ("good_name",), ("article", "good_name"), ())
REST = ("nav", "header", "footer", "aside", "form", "dialog", "bad_name", "bad_part", "ad_name", "notice_name", "replies", "below_replies")
PROSE = ("nav", "header", "footer", "aside", "form", "dialog", "ad_name", "notice_name", "replies", "below_replies")
#: How often a redrawn block of content stands under a name of boilerplate, and the words from which it is content still.
MISNAMED, LONG = 0.15, 20


def _redrawn(x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The page's blocks under other elements and names, and its content once more under those of boilerplate."""
    x, y = np.vstack([x, x[y == 1]]), np.concatenate([y, np.zeros(int(y.sum()))])
    content = y == 1
    prose = np.arange(len(y)) >= len(y) - content.sum()
    x[:, _HIDDEN] = 0
    if rng.random() < 0.25:  # a page that has no paragraphs
        x[x[:, _AT["p"]] == 1, _AT["loose"]] = 1
        x[:, _AT["p"]] = 0
    around = CONTENT[rng.integers(len(CONTENT))]
    inside = content | (rng.random(len(y)) < 0.5)
    for name in around:
        x[inside, _AT[name]] = 1
    x[~inside, _AT["elsewhere"]] = float("article" in around)
    x[x[:, _AT["article"]] == 1, _AT["imprint"]] = 0
    for rows, names in ((~content & ~prose, REST), (prose, PROSE)):
        at = np.flatnonzero(rows)
        x[at, np.array([_AT[n] for n in names])[rng.integers(len(names), size=len(at))]] = 1
    misnamed = np.flatnonzero(content & (rng.random(len(y)) < MISNAMED))
    x[misnamed, np.array([_AT["bad_name"], _AT["bad_part"]])[rng.integers(2, size=len(misnamed))]] = 1
    y[misnamed] = x[misnamed, _AT["words"]] >= math.log1p(LONG)
    return x, y


def examples(page: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of a page with articles: each block as it is, with what the elements around it say left out, with its own kind left out, too, and redrawn."""
    own = blocks(page)
    x = features(own)
    rest = _BIT["nav"] | _BIT["footer"] | _BIT["aside"] | _BIT["form"] | _BIT["dialog"] | _BIT["ad_name"] | _BIT["notice_name"] | _BIT["replies"]
    y = np.array([float(bool(b.bits & _BIT["article"]) and not b.bits & rest) for b in own])
    if not y.any():
        return x[:0], y[:0]
    if len(own) > LEARNT:
        some = np.arange(LEARNT) * len(own) // LEARNT
        x, y = x[some], y[some]
    bare, text = x.copy(), x.copy()
    bare[:, _HIDDEN] = 0
    text[:, [*_HIDDEN, *_KINDS]] = 0
    rng = np.random.default_rng(zlib.crc32(page.encode("utf-8", "surrogatepass")))
    more = [_redrawn(x, y, rng) for _ in range(REDRAWN)]
    return np.vstack([x, bare, text, *(a for a, _ in more)]), np.concatenate([y, y, y, *(b for _, b in more)])


def train(pages: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from the pages with the smallest hashes, in one task."""
    rows = pages.select(F.xxhash64("url", "html").alias("h"), "html").where("html is not null")
    # `sample` bounds the side that is sent to all executors
    chosen = rows.join(F.broadcast(rows.select("h").distinct().orderBy("h").limit(sample)), "h").dropDuplicates(["h"]).select("h", "html").repartition(1).sortWithinPartitions("h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [examples(page) for batch in batches for page in batch.column("html").to_pylist()]
        w = learn(np.vstack([x for x, _ in got]), np.concatenate([y for _, y in got])) if got else FALLBACK
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], ["w"])

    got = chosen.mapInArrow(run, "w array<double>").collect()  # one short row
    return np.array(got[0]["w"]) if got else FALLBACK


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    w = train(pages)

    def kernel(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(p.as_py(), w) for p in b.column("html")]
        return pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), kernel, "page_id long, url string, text string, n_chars long")
