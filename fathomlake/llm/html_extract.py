"""Main text of web pages by a tree-structured graphical model.

The block elements of a page form a tree, and every run of text is a leaf of
its element.  Each node has a hidden label, content or not, with a unary
potential from its features and a potential with its parent's label.  Features
of elements are tag, class and id words, depth, text, link share and sentences
below them; those of text are words, links, sentences, words that notices and
footers use, place in the page, and the text before and after.  Messages pass
upward and downward once (sum-product), which on a tree yields the exact
marginal of every label.  The weights are trained on labelled pages, each of
them also without its class names and with plain elements, so that no name
decides alone: the gradient of the log likelihood is observed minus expected
features, and the expectations come from the same message passing.

The text leaves whose content marginal is over one half are kept, in page
order.  A block is a run of text between the starts and ends of block elements;
inside it references are decoded and white space becomes one space.  Scripts,
styles, the head, forms' controls and the fallback of media have no text at all,
nor has what is hidden (``hidden``, ``display:none``, ``visibility:hidden``,
``aria-hidden``).

Null and empty pages give an empty text.  Unclosed tags, comments and quotes
end where browsers end them, at the latest at the end of the page; a link ends
at the end of its block, and a control without an end tag is passed over.
Pages are read alone: repeated rows give equal results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# How elements behave.
BLOCKS = frozenset(
    "html body main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody "
    "tfoot tr td th caption blockquote pre figure figcaption form fieldset address details summary hr center dialog "
    "menu hgroup search".split()
)
NO_TEXT = frozenset("script style head noscript template iframe object svg math canvas audio video select option textarea button title".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
CONTROLS = NO_TEXT - RAW - {"head"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SEMANTIC = frozenset("article main section nav header footer aside form table ul ol".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
}
SCOPE = {"ul", "ol", "menu", "dl", "table"}
CUES = {
    "advert": "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion".split(),
    "menu": "nav navigation navbar menu breadcrumb breadcrumbs pagination pager topbar toolbar tabs".split(),
    "edge": "header masthead footer bottom copyright legal imprint logo".split(),
    "side": "sidebar side aside widget related recommended more popular archive tags author".split(),
    "reply": "comment comments reply replies respond discussion disqus reviews feedback".split(),
    "form": "form login signup subscribe newsletter search share social follow".split(),
    "notice": "notice cookie cookies consent alert warning popup modal overlay gdpr message".split(),
    "main": "content main article post entry story text body page prose".split(),
}
CUE_OF = {word: cue for cue, words in CUES.items() for word in words}
# Words of text that is seldom the article's own.
SAYS = {
    "edge": "copyright rights reserved imprint impressum terms privacy powered contact mentions legal reservados droits rechte".split(),
    "notice": "cookie cookies consent accept javascript browser".split(),
    "offer": "subscribe newsletter sponsored advertisement buy sale discount sign login register share follow tweet".split(),
    "more": "related popular recommended archive tags previous next comments replies reply respond".split(),
}
SAYS_OF = {word: cue for cue, words in SAYS.items() for word in words}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*(?:display\s*:\s*none|visibility\s*:\s*hidden)""", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role|data-gold)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
WORD = re.compile(r"[A-Za-z]+")
ENDS = re.compile(r"[.!?\u2026\u3002](?=[\s\"')\u00bb\u201d]|$)")
SPACE = re.compile(r"[ \t\n\r\f\v\xa0]+")


TEXT = "#text"


@dataclass
class Page:
    """Elements and texts in page order, a parent before its children."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    cues: list[frozenset] = field(default_factory=list)
    gold: list[str | None] = field(default_factory=list)
    texts: dict[int, tuple[str, int]] = field(default_factory=dict)  # node: text, characters in links


def parse(html: str) -> Page:
    page = Page()
    stack, open_tags = [], {}
    run, linked, links, hidden = [], 0, 0, 0
    endless: set[str] = set()  # tags that no end tag follows any more
    at, end = 0, len(html)

    def node(tag: str, cues: frozenset, gold: str | None) -> int:
        page.parents.append(stack[-1] if stack else -1)
        page.tags.append(tag)
        page.cues.append(cues)
        page.gold.append(gold)
        return len(page.tags) - 1

    def read(attributes: str) -> tuple[frozenset, str | None]:
        cues, gold = set(), None
        if "=" in attributes:
            for name, *values in ATTRIBUTE.findall(attributes):
                value = "".join(values)
                if name.lower() == "data-gold":
                    gold = value
                else:
                    cues.update(CUE_OF[w] for w in WORD.findall(value.lower()) if w in CUE_OF)
        return frozenset(cues), gold

    def add(tag: str, attributes: str) -> None:
        nonlocal hidden
        stack.append(node(tag, *read(attributes)))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        if not hidden and attributes and HIDDEN.search(attributes):
            hidden = len(stack)

    def flush() -> None:
        nonlocal linked, links
        if run:
            text = SPACE.sub(" ", unescape("".join(run))).strip()
            if text and not hidden:
                page.texts[node(TEXT, frozenset(), None)] = text, linked
            run.clear()
        linked = links = 0

    def pop() -> None:
        nonlocal hidden
        open_tags[page.tags[stack.pop()]] -= 1
        if len(stack) < hidden:
            hidden = 0

    def after_end(tag: str, start: int) -> int:
        """The place after the tag's next end tag; -1 if there is none."""
        if tag in endless:
            return -1
        stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, start)
        close = html.find(">", stop.end()) if stop else -1
        if close < 0:
            endless.add(tag)
        return close + 1 if close >= 0 else -1

    add("html", "")
    while at < end:
        cut = html.find("<", at)
        if cut < 0:
            cut = end
        if cut > at:
            run.append(html[at:cut])
            if links:
                linked += cut - at
        if cut == end:
            break
        if html.startswith("<!--", cut):
            stop = html.find("-->", cut + 4)
            at = end if stop < 0 else stop + 3
            continue
        match = TAG.match(html, cut)
        if match is None:
            after = html[cut + 1 : cut + 2]
            if after and (after in "!?/" or after.isalpha()):
                stop = html.find(">", cut)
                at = end if stop < 0 else stop + 1
            else:
                run.append("<")
                at = cut + 1
            continue
        at = match.end()
        closing, tag, attributes = match[1], match[2].lower(), match[3]
        if tag in BLOCKS:
            flush()
            if closing:
                if tag != "html" and tag != "body" and open_tags.get(tag):
                    while page.tags[stack[-1]] != tag:
                        pop()
                    pop()
                continue
            if open_tags.get("p") and page.tags[stack[-1]] == "p":
                pop()
            if tag in CLOSES:
                near = next((i for i in range(len(stack) - 1, 0, -1) if page.tags[stack[i]] in CLOSES[tag] or page.tags[stack[i]] in SCOPE), 0)
                if near and page.tags[stack[near]] in CLOSES[tag]:
                    while len(stack) > near:
                        pop()
            if tag == "html":
                page.gold[0] = read(attributes)[1] or page.gold[0]
                continue
            if tag == "body" and open_tags.get("body"):
                continue
            add(tag, attributes)
            if tag == "hr":
                pop()
        elif closing:
            if tag == "a":
                links = 0
        elif tag in RAW and not attributes.endswith("/"):
            stop = after_end(tag, at)
            at = end if stop < 0 else stop
        elif (tag in CONTROLS or (attributes and tag not in VOID and HIDDEN.search(attributes))) and not attributes.endswith("/"):
            stop = after_end(tag, at)
            if stop >= 0:
                run.append(" ")
                at = stop
        elif tag == "a":
            links = 1
        elif tag == "br" or tag in VOID:
            run.append(" ")
    flush()
    return page


def _size(n: int) -> int:
    return min(n.bit_length(), 8)


def _share(part: int, whole: int) -> int:
    return round(4 * min(part, whole) / whole) if whole else 0


def _features(page: Page) -> list[list[str]]:
    n = len(page.tags)
    chars, link, words, ends, texts, kids, depth = ([0] * n for _ in range(7))
    for i, (text, linked) in page.texts.items():
        chars[i], link[i], words[i], texts[i] = len(text), min(linked, len(text)), text.count(" ") + 1, 1
        ends[i] = len(ENDS.findall(text))
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        kids[p] += 1
        for sums in (chars, link, words, ends, texts):
            sums[p] += sums[i]
    for i in range(1, n):
        depth[i] = depth[page.parents[i]] + 1
    under, names = [""] * n, [frozenset()] * n
    for i in range(1, n):
        p = page.parents[i]
        under[i] = page.tags[i] if page.tags[i] in SEMANTIC else under[p]
        names[i] = names[p] | page.cues[i] if page.tags[i] != "body" else names[p]
    order = list(page.texts)
    spot = {node: k for k, node in enumerate(order)}
    rows = []
    for i in range(n):
        links = _share(link[i], chars[i])
        if page.tags[i] != TEXT:
            f = ["bias", f"tag={page.tags[i]}", f"words={_size(words[i])}", f"links={links}", f"share={_share(chars[i], chars[0])}",
                 f"depth={min(depth[i], 6)}", f"sentences={_size(ends[i])}", f"texts={_size(texts[i])}",
                 f"per text={_size(words[i] // max(texts[i], 1))}"]
            f += [f"cue={c}" for c in page.cues[i]]
            rows.append(f)
            continue
        p, text, k = page.parents[i], page.texts[i][0], spot[i]
        f = ["text", f"in={page.tags[p]}", f"under={under[i]}", f"text words={_size(words[i])}", f"text links={links}", f"text sentences={min(ends[i], 4)}",
             f"place={_share(k, max(len(order) - 1, 1))}", f"text share={_share(chars[i], chars[0])}", f"siblings={_size(kids[p])}",
             f"beside links={_share(link[p], chars[p])}", f"stops={bool(ENDS.search(text[-2:]))}"]
        f += [f"under cue={c}" for c in names[i]]
        for name, j in (("before", k - 1), ("after", k + 1)):
            if 0 <= j < len(order):
                o = order[j]
                f.append(f"{name}={_size(words[o])},{_share(link[o], chars[o]) // 2},{ends[o] > 0}")
            else:
                f.append(f"{name}=none")
        if words[i] < 40:
            f += sorted({f"says={SAYS_OF[w]}" for w in WORD.findall(text.lower()) if w in SAYS_OF})
        if "\u00a9" in text[:40]:
            f.append("says=edge")
        rows.append(f)
    return rows


def marginals(unary: Sequence[float], parents: Sequence[int], pair: Sequence[Sequence[float]], joint: bool = False) -> tuple[list[float], list, float]:
    """Sum-product on the tree: P(label 1) of each node, P(parent, child labels) if ``joint``, log Z.

    ``unary`` is the score of label 1 over label 0; ``pair[parent][child]`` the
    score of two labels.  Children come after their parents.
    """
    n, exp, log = len(unary), math.exp, math.log

    def add(a: float, b: float) -> float:
        return a + log(1 + exp(b - a)) if a >= b else b + log(1 + exp(a - b))

    up0, up1 = [0.0] * n, list(unary)
    m0, m1 = [0.0] * n, [0.0] * n
    for i in range(n - 1, 0, -1):
        a, b, p = up0[i], up1[i], parents[i]
        m0[i], m1[i] = add(a + pair[0][0], b + pair[0][1]), add(a + pair[1][0], b + pair[1][1])
        up0[p] += m0[i]
        up1[p] += m1[i]
    log_z = add(up0[0], up1[0])
    one, beliefs = [0.0] * n, [None] * n
    down0, down1 = [0.0] * n, [0.0] * n
    for i in range(n):
        if i:
            p = parents[i]
            # all that the parent knows but from this child
            q0, q1 = down0[p] + up0[p] - m0[i], down1[p] + up1[p] - m1[i]
            down0[i], down1[i] = add(q0 + pair[0][0], q1 + pair[1][0]), add(q0 + pair[0][1], q1 + pair[1][1])
            if joint:
                cells = [[q0 + pair[0][0] + up0[i], q0 + pair[0][1] + up1[i]], [q1 + pair[1][0] + up0[i], q1 + pair[1][1] + up1[i]]]
                beliefs[i] = [[exp(c - log_z) for c in row] for row in cells]
        x = (down1[i] + up1[i]) - (down0[i] + up0[i])
        one[i] = 1 / (1 + exp(-x)) if x > -700 else 0.0
    return one, beliefs, log_z


@dataclass(frozen=True)
class Weights:
    unary: dict[str, float]
    pair: tuple[tuple[float, float], tuple[float, float]]


def _gold(page: Page) -> list[int]:
    labels = []
    for i, p in enumerate(page.parents):
        labels.append(int(page.gold[i]) if page.gold[i] is not None else labels[p] if p >= 0 else 0)
    return labels


def train(pages: Sequence[str], rounds: int = 80, rate: float = 0.4, penalty: float = 0.01) -> Weights:
    """Fit the weights to pages whose labels are in ``data-gold``."""
    parsed = [parse(p) for p in pages]
    data = [(_features(p), p.parents, _gold(p)) for p in parsed]
    names = sorted({f for rows, _, _ in data for r in rows for f in r})
    spot = {f: i for i, f in enumerate(names)}
    data = [([[spot[f] for f in r] for r in rows], parents, gold) for rows, parents, gold in data]
    w, pair = np.zeros(len(names)), np.zeros((2, 2))
    g2w, g2p = np.full(len(names), 1e-6), np.full((2, 2), 1e-6)
    for _ in range(rounds):
        gw, gp = -penalty * w, -penalty * pair
        table = pair.tolist()
        for rows, parents, gold in data:
            unary = [float(w[r].sum()) for r in rows]
            one, beliefs, _ = marginals(unary, parents, table, joint=True)
            for i, r in enumerate(rows):
                gw[r] += gold[i] - one[i]
                if i:
                    p = parents[i]
                    gp[gold[p], gold[i]] += 1
                    gp -= beliefs[i]
        g2w += gw * gw
        g2p += gp * gp
        w += rate * gw / np.sqrt(g2w)
        pair += rate * gp / np.sqrt(g2p)
    return Weights(dict(zip(names, w.tolist(), strict=True)), tuple(map(tuple, pair.tolist())))


@lru_cache(1)
def default_weights() -> Weights:
    """Trained on the labelled pages that come with the module."""
    from .labelled_pages import training_pages

    return train(training_pages())


def main_text(html: str | None, weights: Weights) -> str:
    if not html:
        return ""
    page = parse(html)
    if not page.texts:
        return ""
    known = weights.unary.get
    unary = [sum(known(f, 0.0) for f in row) for row in _features(page)]
    one, _, _ = marginals(unary, page.parents, weights.pair)
    return "\n".join(text for node, (text, _) in page.texts.items() if one[node] > 0.5)


def extract(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url"), weights: Weights | None = None) -> DataFrame:
    """Columns ``keep`` and text, for every row; pages are read alone."""
    fitted = weights or default_weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), fitted) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[f.name for f in schema])

    given = df.select(*[F.col(c) for c in keep], text_or_empty(html_col).alias("_html"))
    schema = given.withColumnRenamed("_html", "text").schema
    return given.mapInArrow(run, schema)
