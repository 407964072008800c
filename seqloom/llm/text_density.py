"""Main text of web pages by composite text density.

A page becomes a tree of elements.  Each has the characters and tags under it and how many of them are in links; the
composite density is its characters for each tag, scaled down the more of them are links (Sun, Song, Liao, 2011).  Of
the elements that hold blocks, the one whose children's densities have the largest sum is the core.  The least density on
the way from the body down to the core is the threshold that other parts have to reach to count as content beside it.

Densities decide; that an element says of itself that it is an article or the main part is a prior, a factor PRIOR on
its sum, and on the threshold for parts outside of it.  Within the core nothing is dropped but the parts below.

Parts that are no article by their element, role, class or id (menus, page headers, footers, sidebars, notices,
adverts, forms, scripts, styles, reader comments, hidden elements) are left out before, and, outside of articles, lists
and tables that are all links.

Defined results: a null, empty or text-less page gives the empty string; repeated pages each get a row; an empty table
gives an empty result; other columns are ignored; broken mark-up is read as browsers do (an unclosed paragraph ends at
the next block, an unfinished tag at the end is dropped, an unfinished reference is text).  Work is linear in a page,
however deep it nests.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: HTML's element classes
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br body html head caption td th tr tbody thead tfoot option legend title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the first kind ends an open one of the second; the search stops at the third.
ENDS = {
    "li": ("li", frozenset("ul ol menu".split())),
    "dt": ("dt dd", frozenset(["dl"])),
    "dd": ("dt dd", frozenset(["dl"])),
    "tr": ("tr", frozenset(["table"])),
    "td": ("td th", frozenset("tr table".split())),
    "th": ("td th", frozenset("tr table".split())),
    "option": ("option", frozenset(["select"])),
}
# fixed values: what is no article
DROPPED_TAGS = frozenset("script style noscript template nav aside footer form button select textarea input iframe object embed svg canvas audio video head title dialog menu datalist noembed noframes xmp frameset search".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note status".split())
COMMENT_NAMES = frozenset("comment comments commentlist commentarea disqus discussion replies respond usercomments readercomments".split())
DROPPED_NAMES = COMMENT_NAMES | frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertising adsense adbox adslot banner promo promotion sponsor sponsored sponsors cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall sidebar sidenav rail menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar related recommended recommendations share sharing social widget widgets pagination pager skip searchbox".split()
)
KEEPERS = frozenset("article main".split())
#: Elements that hold blocks, and so can be the core.
HOLDERS = frozenset("article body center dd details div fieldset html li main ol section table tbody td tr ul".split()) | {""}
PRIOR = 2.0

OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^>\"']*>")
ATTRIBUTE = re.compile(r"""[\s/]*([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*)))?""")
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Node:
    __slots__ = ("tag", "up", "index", "kids", "attrs", "drop", "c", "t", "lc", "lt", "dens", "sum", "holds", "inside")

    def __init__(self, tag: str, up: Node | None, index: int, attrs: dict[str, str]) -> None:
        self.tag, self.up, self.index, self.attrs = tag, up, index, attrs
        self.kids: list[Node | str] = []
        self.drop = self.holds = self.inside = False
        self.c = self.t = self.lc = self.lt = 0
        self.dens = self.sum = 0.0


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from a tag's name on, and the place after its '>'; -1 if the page ends first."""
    plain = PLAIN.match(page, at)
    end = plain.end() if plain else -1
    out: dict[str, str] = {}
    while True:
        while at < len(page) and (page[at].isspace() or page[at] == "/"):
            at += 1
        if at >= len(page):
            return out, -1
        if page[at] == ">":
            return out, at + 1
        if end > 0 and at >= end:
            return out, end
        m = ATTRIBUTE.match(page, at)
        if not m or m.end() == at:
            if page[at] in "\"'":  # a quote that never closes takes the rest, as in browsers
                close = page.find(page[at], at + 1)
                if close < 0:
                    return out, -1
                at = close + 1
            else:
                at += 1
            continue
        out.setdefault(m[1].lower(), html.unescape(next((v for v in m.groups()[1:] if v is not None), "")))
        at = m.end()


class _Open:
    """The open elements, innermost last, and how many of each there are, so that no search goes up in vain."""

    def __init__(self, root: Node) -> None:
        self.now, self.count = root, Counter()

    def push(self, node: Node) -> None:
        self.now = node
        self.count[node.tag] += 1

    def to(self, node: Node) -> None:
        """Closes what is open within node."""
        while self.now is not node:
            self.count[self.now.tag] -= 1
            self.now = self.now.up

    def close(self, tag: str) -> None:
        if not self.count[tag]:
            return
        x = self.now
        while x.tag != tag:
            if x.tag in ("article", "body", "table", "td") and tag not in ("article", "body", "html", "table", "tr", "main"):
                return
            x = x.up
        if x.up is not None:
            self.to(x.up)

    def end(self, tags: tuple[str, ...], stop: frozenset) -> None:
        """An open one of tags ends, unless another block or a stop is within it."""
        if not any(self.count[t] for t in tags):
            return
        x = self.now
        while x is not None and x.tag not in stop:
            if x.tag in tags:
                self.to(x.up)
                return
            if x.tag in BLOCK and x.tag not in ("p", "li", "dt", "dd", "tr", "td", "th", "option", "tbody", "thead", "tfoot"):
                return
            x = x.up


def parse(page: str) -> list[Node]:
    """Elements in page order; the first is a root above all."""
    root = Node("", None, 0, {})
    nodes, open_, at, n = [root], _Open(root), 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            open_.now.kids.append(html.unescape(page[at:]))
            break
        if lt > at:
            open_.now.kids.append(html.unescape(page[at:lt]))
        m = OPEN.match(page, lt)
        if not m:
            nxt = page[lt + 1 : lt + 2]
            if nxt in ("!", "?", "/"):
                mark = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
                end = page.find(mark, lt + 2)
                at = n if end < 0 else end + len(mark)
            else:
                open_.now.kids.append("<")
                at = lt + 1
            continue
        tag = m[2].lower()
        if m[1]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            if end >= 0:
                open_.close(tag)
            continue
        attrs, at = _attributes(page, m.end())
        if at < 0:
            break
        if tag in CLOSES_P:
            open_.end(("p",), frozenset("button table td th caption object".split()))
        if tag in ENDS:
            names, stop = ENDS[tag]
            open_.end(tuple(names.split()), stop)
        if tag in ("html", "body") and any(x.tag == tag for x in nodes[:8]):
            continue
        node = Node(tag, open_.now, len(nodes), attrs)
        nodes.append(node)
        open_.now.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
            at = page.find(">", end.start()) + 1 or n if end else n
        elif tag not in VOID:
            open_.push(node)
    return nodes


def _names(node: Node) -> set[str]:
    said = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
    whole = said.lower().split()
    return {w.lower() for w in NAME_PARTS.findall(said)} | {p for w in whole for p in re.split("[_-]+", w)} | {re.sub("[_-]", "", w) for w in whole}


def _dropped(node: Node, inside: bool) -> bool:
    """Whether an element is no part of an article; inside: it stands in an article or the main part."""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED_TAGS or tag == "header" and not inside:
        return not node.holds or tag in ("script", "style", "template", "head")
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return not node.holds
    if tag in ("html", "body", "main"):
        return False
    if attrs.get("role", "").lower() in DROPPED_ROLES and not node.holds:
        return True
    if "class" in attrs or "id" in attrs:
        names = _names(node)
        if names & {"has", "with", "no", "without"}:
            return False
        if names & COMMENT_NAMES:
            return not node.holds or tag == "article"
        if tag not in KEEPERS and not node.holds:
            return bool(names & DROPPED_NAMES) or "header" in names and not inside and not any(isinstance(k, Node) and k.tag == "h1" for k in node.kids)
    return False


def _measure(nodes: list[Node]) -> None:
    """Characters, tags and densities of every element that is kept; children come after their parents."""
    for x in reversed(nodes[1:]):  # which elements hold an article
        if (x.tag in KEEPERS and not (_names(x) & COMMENT_NAMES) or x.holds) and x.up is not None:
            x.up.holds = True
    for x in nodes[1:]:
        x.inside = x.up.inside or x.up.tag in KEEPERS
        x.drop = x.up.drop or _dropped(x, x.inside)
    for x in reversed(nodes):
        if x.drop:
            continue
        own = sum(len(k.strip()) for k in x.kids if isinstance(k, str))
        x.c += own
        x.t += 1
        if x.tag == "a":
            x.lc, x.lt = x.c, x.lt + 1
        if x.up is not None:
            x.up.c += x.c
            x.up.t += x.t
            x.up.lc += x.lc
            x.up.lt += x.lt
    body = next((x for x in nodes if x.tag == "body"), nodes[0])
    share = body.lc / max(1, body.c)
    for x in nodes:
        if x.drop or not x.c:
            continue
        base = math.log(x.c / max(1, x.c - x.lc) * x.lc + share * x.c + math.e)
        scale = math.log(x.c / max(1, x.lc) * x.t / max(1, x.lt)) / math.log(base) if base > 1.000001 else 1.0
        x.dens = max(0.0, x.c / x.t * scale)
    for x in nodes:
        if not x.drop:
            x.sum = sum(k.dens if isinstance(k, Node) else len(k.strip()) for k in x.kids)


def _content(nodes: list[Node]) -> list[Node]:
    """The elements whose text is the article's, in page order, none within another."""
    weight = lambda x: x.sum * (PRIOR if x.tag in KEEPERS or x.attrs.get("role") == "main" else 1.0)
    core = max((x for x in nodes if not x.drop and x.tag in HOLDERS), key=lambda x: (weight(x), -x.index))
    path, x = [], core
    while x is not None and x.tag not in ("body", "html", ""):
        path.append(x)
        x = x.up
    if not path:
        return [core]
    threshold = min(p.dens for p in path)

    def needed(k: Node, p: Node) -> float:
        """The density that k has to reach beside p, a part of the path."""
        if k.tag in KEEPERS or k.holds:
            return threshold / PRIOR
        return threshold * (PRIOR if p.tag in KEEPERS or p.holds else 1.0)

    here = 0  # the last part of the path that has content beside it
    for i, p in enumerate(path):
        if any(isinstance(k, Node) and k is not p and not k.drop and k.c and k.dens >= needed(k, p) for k in p.up.kids):
            here = i + 1
    out = [core]
    for p in path[:here]:
        beside = [k for k in p.up.kids if isinstance(k, Node) and k is not p and not k.drop]
        out += [k for k in beside if k.dens >= needed(k, p) or (k.tag in HEADINGS or k.tag == "p") and not (p.tag in KEEPERS or p.holds)]
    return sorted(out, key=lambda k: k.index)


def _is_menu(x: Node) -> bool:
    """Outside of articles, a list or table that is all links."""
    return x.tag in ("ul", "ol", "div", "section", "table") and not x.inside and x.lt >= 3 and x.lc > 0.7 * x.c


def _blocks(top: Node) -> list[str]:
    out: list[str] = []
    now: list[str] = []
    stack: list[Node | str | None] = [top]
    while stack:
        x = stack.pop()
        if x is None:  # a block's end
            out.append("".join(now))
            now = []
        elif isinstance(x, str):
            now.append(x)
        elif not x.drop and not (x is not top and _is_menu(x)):
            if x.tag in BLOCK:
                out.append("".join(now))
                now = []
                stack.append(None)
            stack.extend(reversed(x.kids))
    out.append("".join(now))
    return out


def main_text(page: str) -> str:
    if not page:
        return ""
    nodes = parse(page)
    _measure(nodes)
    blocks = [" ".join(b.split()) for x in _content(nodes) for b in _blocks(x)]
    return " ".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    src = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return src.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
