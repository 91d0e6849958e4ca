"""Main text of web pages by tag-path ratios.

Each text node of a page has a root-to-leaf tag path. Over all nodes of a path, text length and punctuation marks are
summed and divided by the number of nodes (tag-path feature fusion, Wu and others, 2013): prose sits on few paths
with long, punctuated nodes, while menus spread short ones. Both ratios are smoothed along the page and fused by their product. What
a page says of its own elements (navigation, footers, class names such as `comment-list`) is one more feature: it tells such paths
from others with the same tags, and weighs them down; single blocks (paragraphs, items) by no more than much prose outweighs. Paths
whose score reaches a threshold, relative to the page's mean, hold content.

Their nodes are the text, with what belongs to them: in the lowest element that holds them all, headings, captions, short
items and so on, unless a path was weighed down and is no content, or a subtree without any content node is mostly links and
no `article` or `main` says that it belongs.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=]|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PUNCT = re.compile(r"[.,;:!?…。，？！]")

#: Elements of HTML by what they do to the text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
UNSEEN = frozenset("head script style noscript template iframe object embed svg canvas audio video button select option textarea input datalist dialog title xmp noembed noframes".split())
ELSE_TAGS = frozenset("nav aside footer form menu".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HOLDS = frozenset("ul ol dl table tbody thead tfoot select article section div main body".split())
LEAVES = frozenset("p li h1 h2 h3 h4 h5 h6 td pre blockquote".split())
ROOTS = frozenset("html body article main".split())
#: What the last word of a class, id or role calls an element that isn't the article.
ELSE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert"
    " nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside side footer toolbar topbar comment comments disqus respond replies reply"
    " newsletter subscribe subscription signup login popup modal overlay share sharing social related recommended recommendations widget widgets pagination pager search complementary contentinfo".split()
)
#: Of a header outside the article.
HEADER_WORDS = frozenset("header masthead".split())
#: Words after those that only say where it is or how it is laid out, and before them that say it isn't there.
PLACE_WORDS = frozenset("area bar block body bottom box button buttons center col column container content desktop global group holder inner item items layout left leaderboard links list main mobile outer panel posts primary right secondary section site slot stories thread top unit widget wrap wrapper".split())
NOT_WORDS = frozenset("has no non not with without".split())
#: What a path is weighed by for each of its elements that says it is something else; and for a single block that only its names call so.
ELSE_WEIGHT, BLOCK_WEIGHT = 1e-3, 0.3


def _is_else(attrs: str, inside: bool) -> bool:
    """Whether an element's names call it something else than the article; inside: whether it is in one."""
    for m in _NAMES.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()) if w]
            while len(words) > 1 and words[-1] in PLACE_WORDS:
                words.pop()
            if words and words[0] not in NOT_WORDS and (words[-1] in ELSE_WORDS or (words[-1] in HEADER_WORDS and not inside)):
                return True
    return False


@dataclass
class Page:
    """A page's elements and text nodes, in page order. Element 0 is the page itself; parents come before children."""

    tag: list[str] = field(default_factory=lambda: [""])
    parent: list[int] = field(default_factory=lambda: [0])
    path: list[int] = field(default_factory=lambda: [0])  # number of the element's tag path
    weight: list[float] = field(default_factory=lambda: [1.0])  # product of what the elements on the way weigh
    paths: dict[tuple, int] = field(default_factory=lambda: {(): 0})
    # of each text node: its element, path, block, text, and whether it is a link
    nodes: list[tuple[int, int, int, str, bool]] = field(default_factory=list)

    def open(self, name: str, parent: int, weight: float) -> int:
        self.tag.append(name)
        self.parent.append(parent)
        self.path.append(self.paths.setdefault((self.path[parent], name, weight), len(self.paths)))
        self.weight.append(self.weight[parent] * weight)
        return len(self.tag) - 1


def parsed(page: str) -> Page:
    """The page's elements and the text nodes that are seen, in time linear in its length."""
    out, block, pos = Page(), 0, 0
    stack: list[tuple[str, int, bool]] = []  # name, element, unseen
    opened: Counter[str] = Counter()
    link = False
    closed: dict[str, int] = {}  # where an inline element is closed for the last time
    muted: tuple[str, int, int] | None = None  # an inline element that isn't the article: name, how deep, elements open then

    def text(piece: str) -> None:
        if muted or not piece or (stack and stack[-1][2]):
            return
        if not (piece := _html.unescape(piece)).isspace():
            at = stack[-1][1] if stack else 0
            path = out.paths.setdefault((out.path[at], "a", 1.0), len(out.paths)) if link else out.path[at]
            out.nodes.append((at, path, block, piece, link))
        else:
            space()

    def space() -> None:
        if out.nodes and out.nodes[-1][2] == block:
            out.nodes[-1] = (*out.nodes[-1][:3], out.nodes[-1][3] + " ", out.nodes[-1][4])

    def close(k: int) -> None:
        nonlocal link, muted
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]
        link = False
        if muted and muted[2] > k:
            muted = None

    def last(names: set[str], until: frozenset = frozenset()) -> int | None:
        """The innermost open element of these names; none beyond one of until."""
        if any(opened[x] for x in names):
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in names:
                    return k
                if stack[k][0] in until:
                    return None
        return None

    while pos < len(page):
        m = _TAG.search(page, pos)
        text(page[pos : m.start()] if m else page[pos:])
        if not m:
            break
        pos = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        ending, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        inside = opened["article"] > 0 or opened["main"] > 0
        if name == "br":
            space()
        if name in INLINE:
            if name == "a":
                link = not ending
            if muted and name == muted[0] and name not in VOID:
                deep = muted[1] + (-1 if ending else 1)
                muted = (name, deep, muted[2]) if deep else None
            elif not muted and not ending and name not in VOID and attrs and (_is_else(attrs, inside) or _HIDDEN.search(attrs)):
                if name not in closed:
                    closed[name] = page.lower().rfind(f"</{name}")
                if closed[name] >= pos:
                    muted = (name, 1, len(stack))
            continue
        if name in VOID:
            block += name == "hr"
            continue
        block += 1
        if ending:
            if (k := last({name})) is not None:
                close(k)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(page, pos)
            pos = end.end() if end else len(page)
            continue
        if name in ENDS_P and (k := last({"p"})) is not None:
            close(k)
        if name in CLOSED_BY and (k := last(CLOSED_BY[name], HOLDS)) is not None:
            close(k)
        if name == "body" and (k := last({"head"})) is not None:
            close(k)
        weight = 1.0
        if name in ELSE_TAGS or (name == "header" and not inside):
            weight = ELSE_WEIGHT
        elif name not in ROOTS and attrs and _is_else(attrs, inside):
            weight = BLOCK_WEIGHT if name in LEAVES else ELSE_WEIGHT
        unseen = (bool(stack) and stack[-1][2]) or name in UNSEEN or bool(attrs and _HIDDEN.search(attrs))
        stack.append((name, out.open(name, stack[-1][1] if stack else 0, weight), unseen))
        opened[name] += 1
    return out


def _smoothed(x: np.ndarray, reach: int) -> np.ndarray:
    k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / max(reach / 2, 0.5)) ** 2)
    padded = np.pad(x, reach, mode="edge")
    return np.convolve(padded, k / k.sum(), mode="valid")


def content_paths(found: Page, share: float = 0.5, reach: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Which nodes are on paths that hold content, and the score of each node's path."""
    _, of = np.unique(np.array([x[1] for x in found.nodes]), return_inverse=True)
    chars = np.array([len(x[3].strip()) for x in found.nodes], float)
    punctuation = np.array([len(_PUNCT.findall(x[3])) for x in found.nodes], float)
    weight = np.maximum([found.weight[x[0]] for x in found.nodes], 1e-90)  # the same all over a path
    many = np.bincount(of)
    text_ratio, mark_ratio = np.bincount(of, chars) / many, (np.bincount(of, punctuation) + 0.1) / many
    # weighed before smoothing, so that it lends nothing to its neighbours, and after, so that it takes nothing from them
    fused = _smoothed(text_ratio[of] * weight, reach) * _smoothed(mark_ratio[of] * weight, reach) * weight
    score = (np.bincount(of, fused) / many)[of]
    mean = float((score * chars * weight).sum() / (chars * weight).sum()) if (chars * weight).sum() > 0 else 0.0
    content = score >= share * mean
    return (content if content.any() else score == score.max()), score


def chosen_nodes(found: Page, content: np.ndarray) -> np.ndarray:
    """The nodes of the text: content nodes and what belongs to them in the lowest element that holds them all."""
    parent, element = found.parent, [x[0] for x in found.nodes]
    holds = [False] * len(parent)  # a content node
    for e in (e for e, c in zip(element, content) if c):
        while not holds[e]:
            holds[e] = True
            e = parent[e]
    # numbers rise along the page: what holds the first and the last holds all
    first, last = (element[k] for k in (int(np.argmax(content)), len(content) - 1 - int(np.argmax(content[::-1]))))
    while first != last:
        if first > last:
            first = parent[first]
        else:
            last = parent[last]
    root = first
    while root and found.tag[root] in LEAVES:
        root = parent[root]  # one chosen block: what stands around it in its container belongs to it
    within = [False] * len(parent)
    top = list(range(len(parent)))  # the outermost element around that holds no content node
    for e in range(len(parent)):
        within[e] = e == root or (e > 0 and within[parent[e]])
        if e and not holds[e] and not holds[parent[e]]:
            top[e] = top[parent[e]]
    nodes, chars, linked = Counter(), Counter(), Counter()
    for e, _, _, text, link in found.nodes:
        if not holds[e]:
            n = len(text.strip())
            nodes[top[e]] += 1
            chars[top[e]] += n
            linked[top[e]] += n * link
    up, article = root, False  # in an article's own element lists of links are its references
    while up and not article:
        article, up = found.tag[up] in ("article", "main"), parent[up]
    menu = {e for e, n in nodes.items() if n > 1 and 2 * linked[e] > chars[e] and not article}
    return np.array([bool(c) or (within[e] and found.weight[e] == found.weight[root] and (holds[e] or top[e] not in menu)) for e, c in zip(element, content)], bool)


def main_text(page: str | None, share: float = 0.5, reach: int = 2) -> str:
    """The main text of one page; share: the part of the page's mean path score that a content path reaches."""
    found = parsed(page or "")
    if not found.nodes:
        return ""
    keep = chosen_nodes(found, content_paths(found, share, reach)[0])
    blocks: dict[int, list[str]] = {}
    for (_, _, block, text, _), k in zip(found.nodes, keep):
        if k:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n\n".join(x for x in lines if x)


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text) of each row of pages(page_id, url, html): the text of its article.

    Character references are decoded, white space in a block is one space, blocks are joined by two newlines in page order.
    A null, empty or textless page gives the empty text; broken markup is read as far as it goes; repeated rows each give
    their row; other columns are ignored.
    """
    kind = dict(pages.dtypes)["page_id"]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())], names=["page_id", "url", "text"])

    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
