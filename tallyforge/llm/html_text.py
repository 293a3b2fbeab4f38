"""Operator 8: main text of web pages by minimum-cut labelling.

A page is cut into text blocks at block-level tags. A logistic classifier gives each
block the log-odds of content against boilerplate; these are its terminal capacities.
Neighbouring blocks are joined by smoothness edges, stronger the closer they stand in
the element tree (one parent, or one's parent holding the other's, against blocks further
apart), and blocks of one parent across a gap by weaker ones. The minimum cut (max-flow
over the residual graph) labels all blocks of a page at once, so a short line or list
between paragraphs of an article goes with them.

The classifier's inputs are the block's text (length, links, how it ends, likeness to
the page's title), its place (tag, depth, what stands under the same parent, how
far down the page), words of class and
id names (of its element and the one around it, and apart from these of elements further
out), and whether it stands in a navigation, footer, aside, form or the like. A name with a
word that turns it round (no-sidebar, comments-open) counts as none. An article or main
element ends what the elements around it say; and an element that holds an article, the
page's heading, or both a header and a footer, only wraps the page and says nothing.

All weights are learned, none is beyond what the cut can turn. Labels come from a bounded
sample of pages that have an article or main element: blocks in it are content, blocks
outside it are not. Text and place learn first; then what names and elements say is learned
on top of that, where blocks in an article whose names or elements speak against them count
with the probability that text and place give them. Weights start from, and are held near, prior ones,
which serve alone where no page has such an element.

Defined cases: null and empty html give an empty text; markup that never closes ends
with the page; text outside any element is a block; scripts, styles, the head and
hidden elements are never text; very long pages are labelled whole (the cut first
settles all blocks whose own capacity outweighs their edges, then takes the rest in
pieces); repeated rows get equal texts; null ids stay; an empty table gives an empty
result; columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import hashed_sample, table

RAW = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|select|svg|iframe|object|head)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
TITLE = re.compile(r"<title\b[^>]*>(.*?)</title\s*>", re.S | re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^<>])*+)>|<[!?][^>]*>""")
ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TOKEN = re.compile(r"[a-z]+")

# Elements by what they mean for blocks, and words of class and id names.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CHROME = frozenset("nav header footer aside form menu dialog button fieldset".split())
CONTENT = frozenset("article main".split())
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices popup modal overlay "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead toolbar comment comments disqus reply replies respond "
    "share sharing subscribe newsletter signup login".split()
)
VAGUE_WORDS = frozenset("rail widget header social related recommended pagination pager tags toc legal copyright".split())
TURNED = frozenset("no not without has with open opened closed enabled disabled hide hidden".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li td dd figcaption".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SHUTS_P = frozenset("p h1 h2 h3 h4 h5 h6 ul ol div section article table blockquote pre hr form footer header nav aside main dl figure".split())

#: Pages from which the classifier learns, at most.
SAMPLE = 1_000
#: Weights of edges: one parent, a parent in the other's, one parent across a gap, others (by distance in the tree), a block and the long texts around it.
NEAR, NESTED, SAME_PARENT, FAR, BETWEEN = 3.0, 2.5, 1.5, 0.3, 1.5
#: What standing in an article or main element adds to the log-odds; it can't be learned, as the labels come from it.
INSIDE = 1.5
#: Bound of the classifier's log-odds; characters from which a block's text is long.
MOST, LONG = 12.0, 100
#: The inputs, and the weights that hold before any page is seen (the first is the bias).
INPUTS = ("bias", "length", "linked", "sentence", "short", "paragraph", "heading", "title", "item", "siblings", "parent text", "parent linked", "named", "named above", "vague", "stated", "top", "bottom", "depth")
PRIOR = np.array([-1.5, 0.8, -3.0, 0.8, -0.5, 0.8, 0.5, 1.0, -0.5, 0.8, 1.2, -2.0, -5.0, -2.5, -1.0, -6.0, 0.0, 0.0, 0.0])
SAYING = [INPUTS.index(x) for x in ("named", "named above", "vague", "stated")]
#: Elements above a block's parent that count for distances in the tree.
REACH = 6
#: How firmly the prior holds, counted in pages of a sample.
FIRMNESS = 0.02


class Block:
    __slots__ = ("text", "linked", "tag", "element", "parent", "depth", "above", "stated", "inside", "named", "far", "vague")

    def __init__(self, text, linked, tag, element, parent, depth, above):
        self.text, self.linked, self.tag, self.depth, self.element = text, linked, tag, depth, element
        #: number of the element that holds the block's paragraph, and of those around it, from the inside
        self.parent, self.above = parent, above

    def told(self, e: Element, around: Element) -> None:
        """What the innermost element and the one around it say."""
        #: in an element that states another role; in an article or main element
        self.stated, self.inside = e.stated, e.inside
        #: its element or the one around it has a word of the first list in its names, one further out has, one of the second list
        near = e.own or (around.own and not e.content)
        self.named, self.far, self.vague = near, e.named and not near, e.vague


#: What an element may hold.
HEADED, ARTICLE, FOOTED, TOPPED = 1, 2, 4, 8
HOLDS = {"h1": HEADED, "article": ARTICLE, "main": ARTICLE, "footer": FOOTED, "header": TOPPED, "nav": TOPPED}


class Element:
    __slots__ = ("tag", "content", "role", "own", "maybe", "gone", "holds", "up", "stated", "inside", "named", "vague", "hidden")

    def __init__(self, tag: str, attrs: str, up: int):
        self.tag, self.up, self.content, self.role, self.holds = tag, up, tag in CONTENT, tag in CHROME, 0
        self.own, self.maybe, self.gone = names_of(attrs) if attrs else (False, False, False)
        if tag in ("html", "body") or self.content:
            self.own = self.maybe = False

    def told(self, around: Element) -> None:
        """Take in what the element around it says; called from the outside in, once all elements are known."""
        wraps = bool(self.holds & ARTICLE) or self.holds & (FOOTED | TOPPED) == FOOTED | TOPPED
        if self.tag not in ("header", "nav", "aside", "footer"):
            wraps = wraps or bool(self.holds & HEADED)
        self.own, self.maybe = self.own and not wraps, self.maybe and not wraps
        self.inside = around.inside or self.content
        # a header inside an article is the article's own
        role = self.role and not wraps and not (self.tag == "header" and around.inside)
        self.stated = not self.content and (around.stated or role)
        self.named = not self.content and (around.named or self.own)
        self.vague = not self.content and (around.vague or self.maybe)
        self.hidden = around.hidden or self.gone


def names_of(attrs: str) -> tuple[bool, bool, bool]:
    """(a class, id or role holds a word of the first list, of the second, is hidden)."""
    named = vague = hidden = False
    for m in ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").lower()
        if name in ("class", "id", "role"):
            for one in value.split():
                words = TOKEN.findall(one)
                if TURNED.isdisjoint(words):
                    named, vague = named or not CHROME_WORDS.isdisjoint(words), vague or not VAGUE_WORDS.isdisjoint(words)
        elif name == "hidden" or name == "aria-hidden" and "true" in value or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
    return named, vague, hidden


def blocks_of(html: str) -> list[Block]:
    html = RAW.sub(" ", html)
    elements, stack = [Element("", "", 0)], [0]  # numbers of the open elements
    out, piece, linked, links, at = [], [], 0, 0, 0

    def flush():
        nonlocal linked
        if piece:
            text = " ".join(unescape("".join(piece)).split())
            piece.clear()
            if text:
                tag = elements[stack[-1]].tag
                up = 2 if len(stack) > 1 and tag in PARAGRAPH else 1
                out.append(Block(text, min(1.0, linked / len(text)), tag, stack[-1], stack[-up], len(stack), stack[-up - 1 : -up - 1 - REACH : -1]))
        linked = 0

    for m in TAG.finditer(html):
        if m.start() > at:
            s = html[at : m.start()]
            piece.append(s)
            if links:
                linked += len(s)
        at = m.end()
        if not m[2]:
            continue
        tag, shut = m[2].lower(), m[1]
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if shut else links + 1
            elif tag == "br":
                piece.append(" ")
            continue
        flush()
        links = 0
        if shut:
            for i in range(len(stack) - 1, 0, -1):
                if elements[stack[i]].tag == tag:
                    del stack[i:]
                    break
        elif tag not in VOID:
            last = elements[stack[-1]].tag
            if tag in SHUTS_P and last == "p" or tag == "li" and last == "li":
                stack.pop()
            kind = HOLDS.get(tag, 0)
            for i in reversed(stack) if kind else ():
                if elements[i].holds & kind:
                    break  # and so have those around it
                elements[i].holds |= kind
            elements.append(Element(tag, m[3], stack[-1]))
            stack.append(len(elements) - 1)
    piece.append(html[at:])
    flush()
    root = elements[0]
    root.stated = root.inside = root.named = root.vague = root.hidden = False
    for e in elements[1:]:
        e.told(elements[e.up])
    for b in out:
        e = elements[b.element]
        b.told(e, elements[e.up])
    return [b for b in out if not elements[b.element].hidden]


def title_of(html: str) -> set[str]:
    m = TITLE.search(html)
    return set(unescape(m[1]).lower().split()) if m else set()


def features(bs: list[Block], title: set[str]) -> np.ndarray:
    """One row a block, as named by ``INPUTS``."""
    many, long, linked = Counter(), Counter(), Counter()
    for b in bs:
        many[b.parent] += 1
        long[b.parent] += len(b.text)
        linked[b.parent] += b.linked * len(b.text)
    whole, n, at, rows = sum(long.values()), len(bs), 0, []
    for i, b in enumerate(bs):
        size, p = len(b.text), b.parent
        words = b.text.lower().split()[:40] if b.tag in HEADING and title else []
        like = sum(w in title for w in words) / len(words) if words else 0.0
        rows.append((
            1.0, min(size, 400) / 200, b.linked, b.text[-1] in ".!?…:;\"'»”)", size < 25, b.tag == "p", b.tag in HEADING, like, b.tag in ("li", "td", "dd"),
            min(many[p], 10) / 5, long[p] / whole, linked[p] / long[p], b.named, b.far, b.vague, b.stated, i < 2, i >= n - 2, min(b.depth, 12) / 6,
        ))
        at += size
    return np.array(rows, np.float64).reshape(-1, len(INPUTS))


class BlockModel:
    def __init__(self, weights: np.ndarray = PRIOR):
        self.weights = weights

    def log_odds(self, bs: list[Block], title: set[str]) -> np.ndarray:
        return (features(bs, title) @ self.weights).clip(-MOST, MOST)

    def kept(self, bs: list[Block], title: set[str]) -> list[bool]:
        odds = self.log_odds(bs, title) + np.array([INSIDE * b.inside for b in bs])
        return labels(odds.tolist(), edges(bs))

    def main_text(self, html: str) -> str:
        bs = blocks_of(html)
        if not bs:
            return ""
        return "\n".join(b.text for b, k in zip(bs, self.kept(bs, title_of(html))) if k)


def nearness(p: Block, b: Block) -> float:
    """Weight of the edge between neighbouring blocks; an element that names its role is a border, however near."""
    if (p.stated, p.named) != (b.stated, b.named):
        return FAR
    if p.parent == b.parent:
        return NEAR
    if b.parent in p.above or p.parent in b.above:
        far = (p.above.index(b.parent) if b.parent in p.above else b.above.index(p.parent)) + 1
        return NESTED / far
    common = next((i for i, e in enumerate(p.above) if e in b.above), REACH)
    return FAR / (1 + common + (b.above.index(p.above[common]) if common < len(p.above) else REACH))


def edges(bs: list[Block]) -> list[tuple[int, int, float]]:
    """Smoothness edges: neighbours, blocks of one parent across a gap, and a block with the long texts of one element that stand around it in this element."""
    out, last = [], {}
    prose = [len(b.text) >= LONG and b.linked < 0.3 and not (b.stated or b.named) for b in bs]
    after, late = [None] * len(bs), None
    for i in range(len(bs) - 1, -1, -1):
        after[i], late = late, i if prose[i] else late
    early = None
    for i, b in enumerate(bs):
        if i:
            out.append((i - 1, i, nearness(bs[i - 1], b)))
            j = last.get(b.parent)
            if j is not None and j != i - 1:
                out.append((j, i, SAME_PARENT))
        last[b.parent] = i
        if prose[i]:
            early = i
        elif early is not None and after[i] is not None and not (b.stated or b.named):
            p = bs[early].parent
            if p == bs[after[i]].parent and (p == b.parent or p in b.above):
                out += [(early, i, BETWEEN), (i, after[i], BETWEEN)]
    return out


def labels(odds: list[float], joins: list[tuple[int, int, float]]) -> list[bool]:
    """Minimum cut: a block on the source side is content.

    ``odds`` above 0 are capacities from the source, below 0 to the sink. A block whose
    capacity is at least that of all its edges together lies on its terminal's side in
    some minimum cut; it is settled, and its edges become its neighbours' capacities,
    which may settle these in turn. Through what is left, flow is pushed.
    """
    n = len(odds)
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in joins:
        near[a][b] = near[a].get(b, 0.0) + c
        near[b][a] = near[b].get(a, 0.0) + c
    left = list(odds)  # what terminal capacity remains
    side: list[bool | None] = [None] * n
    total = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None or abs(left[i]) < total[i] - 1e-12:
            continue
        side[i] = left[i] > 0
        for j, c in near[i].items():
            if side[j] is None:
                del near[j][i]
                total[j] -= c
                left[j] += c if side[i] else -c
                todo.append(j)
        near[i] = {}
    open_ = [i for i in range(n) if side[i] is None]
    source = max_flow(open_, left, near)
    for i in open_:
        side[i] = i in source
    return side


def max_flow(nodes: list[int], left: list[float], near: list[dict[int, float]]) -> set[int]:
    """Dinic's phases: blocking flows along shortest residual paths; the nodes that the source still reaches at the end."""
    while True:
        level = {i: 0 for i in nodes if left[i] > 1e-9}
        todo, sinks = deque(level), False
        while todo:
            i = todo.popleft()
            if left[i] < -1e-9:
                sinks = True
                continue
            for j, c in near[i].items():
                if c > 1e-9 and j not in level:
                    level[j] = level[i] + 1
                    todo.append(j)
        if not sinks:
            return set(level)
        ways, at = {i: list(near[i]) for i in level}, dict.fromkeys(level, 0)
        for s in [i for i in level if level[i] == 0]:
            path = [s]
            while path and left[s] > 1e-9:
                i = path[-1]
                if left[i] < -1e-9:
                    steps = list(zip(path, path[1:]))
                    push = min(left[s], -left[i], *(near[a][b] for a, b in steps))
                    left[s] -= push
                    left[i] += push
                    for a, b in steps:
                        near[a][b] -= push
                        near[b][a] += push
                    full = next((k for k, (a, b) in enumerate(steps) if near[a][b] <= 1e-9), len(steps))
                    del path[full + 1 :]  # go on from the first edge that is full
                    continue
                while at[i] < len(ways[i]):
                    j = ways[i][at[i]]
                    if level.get(j) == level[i] + 1 and near[i][j] > 1e-9:
                        path.append(j)
                        break
                    at[i] += 1
                else:
                    path.pop()
                    if path:
                        at[path[-1]] += 1


def taught(b: Block) -> int | None:
    """The label of a block on a page with an article or main element; None where it may be either."""
    if b.inside:
        return None if b.stated or b.named or b.far or b.vague else 1
    return 0


def learned(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights from blocks with labels 1, 0 and NaN (either).

    Text and place learn first, by themselves, so that they can tell blocks whose names and
    elements say nothing. What these say is learned on top of that, where blocks that may be
    either have the probability that text and place give them.
    """
    sure = ~np.isnan(y)
    if len({*y[sure]}) < 2:
        return PRIOR
    plain = np.delete(np.arange(x.shape[1]), SAYING)
    w = PRIOR.copy()
    w[plain] = logistic(x[sure][:, plain], y[sure], PRIOR[plain])
    odds = x[:, plain] @ w[plain]
    y = np.where(sure, y, 1 / (1 + np.exp(-odds.clip(-30, 30))))
    w[SAYING] = logistic(x[:, SAYING], y, PRIOR[SAYING], offset=odds)
    return w


def fit_block_model(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE) -> BlockModel:
    """Logistic regression on the blocks of at most ``sample`` pages, chosen by hash among all that have an article or main element."""
    named = pages.where(F.regexp_like(html_col, F.lit(r"(?i)<(article|main)\b"))).select(F.lit(1).alias("one"), F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            y, x = [], []
            for h in pdf["html"]:
                bs = blocks_of(h)
                if bs:
                    own = [taught(b) for b in bs]
                    y += own
                    x += features(bs, title_of(h)).tolist()
            if y:
                yield pd.DataFrame({"y": pd.array(y, "Int32"), "x": x})

    # a sample's blocks meet as one sum of outer products for each label and step: the rows themselves are few
    got = hashed_sample(named, "one", sample).repartition(16).mapInPandas(gather, "y int, x array<double>").collect()
    if not got:
        return BlockModel()
    y = np.array([np.nan if r.y is None else r.y for r in got], float)
    x = np.array([r.x for r in got])
    order = np.lexsort(np.hstack([x, y[:, None]]).T)  # the sums don't depend on the order in which rows came
    return BlockModel(learned(x[order], y[order]))


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, firmness: float = FIRMNESS, offset: np.ndarray | float = 0.0) -> np.ndarray:
    """Newton's method for the weights of greatest posterior likelihood, ``offset`` beside them; both labels weigh alike."""
    a, b = y / max(y.sum(), 1), (1 - y) / max((1 - y).sum(), 1)
    w = prior.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-(x @ w + offset).clip(-30, 30)))
        h = (x * ((a + b) * p * (1 - p))[:, None]).T @ x + firmness * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (a * (1 - p) - b * p) - firmness * (w - prior))
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def extract_text(pages: DataFrame, model: BlockModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    d = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            text = [model.main_text(h) if h else "" for h in pdf["html"]]
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": text, "n_chars": [len(t) for t in text]})

    kind = dict(d.dtypes)
    return d.mapInPandas(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, fit_block_model(pages))
