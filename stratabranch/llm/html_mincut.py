"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read as HTML reads it (implied end tags, raw text elements, table scopes) into blocks of
text, each in a tree of containers. A logistic classifier gives a block its odds of being content from its
text, its links, its place in the document, the tags around it, and what the elements and names around it
say; names are features with learned weights like the others. It is trained here, on pages made at
random from parts that are known to be content or not, and on a bounded sample of the table's own pages,
where elements such as article and nav tell a block's kind and are then kept out of its features.

The two costs of a block are its capacities to the two terminals. Neighbours in page order, and the
nearest blocks of one container, are joined by smoothness edges that grow with how much of their path in
the document they share. The minimum cut, from a maximum flow, is the labelling of least total cost: it
decides, and a block may end up against its own odds or against what its container is called.

A furniture name or a form that holds a main, an article that has no content-marked text beside it, or
most of the page's text with hardly any content-marked text outside, is a wrapper and tells nothing.
Class and id names are read as wholes: sidebar-inner is furniture, has-sidebar is a state and tells
nothing; html and body tell nothing by name, article and main are no furniture by name. A header within
an article or main is part of it. An article within a longer one is a
comment, and so is a part that has hardly more than such articles.

Null html is empty. Scripts, styles, markup, hidden parts (inline ones too) and form controls are no
text at all. Character references are decoded, white space inside a block becomes one space, blocks of
the content side are joined in page order by one space. A page without content has an empty text. Unclosed
and stray tags are read as browsers do; a tag that the page ends in is dropped. Reading takes time in proportion
to the page, however broken it is. Repeated rows are done each; a null page_id is carried. An empty table
gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratabranch.llm.common import over_batches, tune

#: Pages learned from (those with the smallest hashes), and blocks of them at most; pages made.
TRAIN_PAGES = 2_000
TRAIN_BLOCKS = 40_000
MADE_PAGES = 800

# Names of HTML elements by what they do to text, and words of class and id
# attributes that name page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noscript noembed noframes xmp".split())
SKIPPED = frozenset("template svg math object canvas select datalist button audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark meter option optgroup output progress q ruby rb rp rt s samp slot small span strike strong sub sup time tt u var".split())
CONTAINERS = frozenset("html body div article section main nav header footer aside form fieldset ul ol dl table tbody thead tfoot tr td th figure blockquote details dialog menu address center search hgroup".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre figcaption summary caption legend".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
AGAINST = frozenset("nav header footer aside form menu dialog search".split())
FOR = frozenset("article main".split())
ROLES_AGAINST = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
FURNITURE = re.compile(
    r"^(ads?|advert\w*|adbox|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notices?|notification\w*|alerts?|popup|modal|newsletter|subscri\w+|signup|login|search|menu\w*|nav\w*|breadcrumbs?|sidebar\w*|side|aside|footer\w*|header\w*|masthead|topbar|toolbar|shar(e|ing)|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|pagination|pager|widgets?|skip|copyright|legal|disclaimer)$"
)
BODY = re.compile(r"^(article\w*|post|postbody|entry|story\w*|content|main\w*|text|body)$")
#: Words that make a name a state of the page, and words that may follow a furniture word in its name.
STATE = frozenset("has have no not is with without hide show".split())
PARTS = frozenset(
    "area articles author bar block blocks body bottom box button buttons col column container content date desktop form group head heading holder icon icons image img info inner inside item items label left link links list media meta mobile next outer panel placeholder posts prev previous primary reply right row secondary section slot stories tab tabs text title to tools top trail unit wrap wrapper zone".split()
)

# What the start of an element ends: groups of elements, each up to others that enclose them.
_OUTER = CONTAINERS - {"address", "div"} | {"button", "object", "template", "svg", "math"}
GROUPS = {
    "p": (frozenset(("p",)), frozenset("button table caption td th object template svg math".split())),
    "li": (frozenset(("li",)), _OUTER),
    "term": (frozenset(("dt", "dd")), _OUTER),
    "cell": (frozenset(("td", "th", "caption")), frozenset(("table", "template", "tr"))),
    "row": (frozenset(("tr", "caption")), frozenset(("table", "template"))),
    "rows": (frozenset(("thead", "tbody", "tfoot", "caption")), frozenset(("table", "template"))),
    "choice": (frozenset(("select", "datalist")), frozenset(("template",))),
    "drawing": (frozenset(("svg", "math")), frozenset(("foreignobject", "template"))),
}
_NAMES = list(GROUPS)
_TABLE_PARTS = frozenset("caption thead tbody tfoot tr td th".split())
_SCOPE = frozenset("table td th caption template object html button".split())


def _ends(tag: str) -> tuple[int, ...]:
    """Indexes of the groups whose nearest element ends where this one starts."""
    ends = []
    if (tag in CONTAINERS or tag in BLOCKS or tag == "hr") and tag not in _TABLE_PARTS:
        ends += ["choice", "drawing"] + (["p"] if tag not in ("html", "body", "table", "legend") else [])
    ends += {"li": ["li"], "dt": ["term"], "dd": ["term"], "td": ["cell"], "th": ["cell"], "tr": ["row"], "thead": ["rows", "row"], "tbody": ["rows", "row"], "tfoot": ["rows", "row"]}.get(tag, [])
    return tuple(map(_NAMES.index, ends))


ENDS = {tag: _ends(tag) for tag in CONTAINERS | BLOCKS | {"hr"}}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ATTRIBUTE = re.compile(r"""[\s/]*+(?:>|([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]*+)))?+)""")
_CLOSERS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Weights of smoothness edges (about the best on held-out made pages), and the range of odds.
NEXT, SIBLING, RANGE = 1.0, 2.0, 8.0
#: A furniture name with most of the page's text is a wrapper if text marked as content outside it is
#: a smaller share of its own than this.
BESIDE = 0.05


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    node: int  # its innermost container
    tag: str  # the block-level element it stands in


@dataclass
class _Mark:
    """What a container says about its text."""

    sign: int
    by_name: bool = False  # by class, id or being a form, which page-wide wrappers are too
    kind: str = ""  # article or main, by tag or role


@dataclass
class _Open:
    tag: str
    node: int
    skipped: bool
    inline: bool
    nearest: tuple[int, ...]  # places in the stack of the nearest element of each group, or -1
    scope: int  # place of the nearest element that end tags don't reach over
    block: int  # place of the nearest element that isn't inline


class Page:
    """Blocks in page order, and the tree of their containers: parent, depth and mark of each."""

    def __init__(self, page: str):
        self.blocks: list[Block] = []
        self.parent, self.depth, self.marks = [-1], [0], [_Mark(0)]
        self._stack = [_Open("", 0, False, False, (-1,) * len(GROUPS), 0, 0)]
        self._where: dict[str, list[int]] = {}
        self._parts: list[str] = []
        self._links = 0
        self._read(page)
        self._end_block()

    def _read(self, page: str) -> None:
        at = 0
        while (lt := page.find("<", at)) >= 0:
            self._text(page[at:lt])
            m = _TAG.match(page, lt)
            if m is None:
                if page.startswith("<!--", lt):
                    end = page.find("-->", lt + 2)
                    at = end + 3
                elif page.startswith("<![CDATA[", lt):
                    end = page.find("]]>", lt)
                    self._text(page[lt + 9 : end if end >= 0 else len(page)])
                    at = end + 3
                elif page[lt + 1 : lt + 2] in ("!", "?", "/"):
                    end = page.find(">", lt)
                    at = end + 1
                else:
                    self._text("<")
                    end, at = lt, lt + 1
                if end < 0:
                    return
                continue
            tag, at, names, slash = m[2].lower(), m.end(), {}, False
            while (a := _ATTRIBUTE.match(page, at)) is not None:
                at = a.end()
                if a[1] is None:
                    slash = page[at - 2] == "/"
                    break
                if not m[1]:
                    names.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
            else:
                return  # the page ends inside the tag
            if m[1]:
                self._end(tag)
                continue
            drawing = self._stack[-1].nearest[_NAMES.index("drawing")] >= 0
            if tag in RAW and not (slash and drawing):
                if tag in ("textarea", "title") and not self._stack[-1].skipped:
                    self._end_block()
                end = _CLOSERS[tag].search(page, at)
                at = page.find(">", end.end()) + 1 if end else 0
                if not at:
                    return
                continue
            self._start(tag, names, slash and (drawing or tag in ("svg", "math")))
        self._text(page[at:])

    def _text(self, raw: str) -> None:
        if raw and not self._stack[-1].skipped:
            raw = entities.unescape(raw) if "&" in raw else raw
            self._parts.append(raw)
            if self._where.get("a"):
                self._links += len(raw.strip())

    def _end_block(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                top = self._stack[self._stack[-1].block]
                self.blocks.append(Block(text, min(self._links, len(text)), self._stack[-1].node, top.tag))
            self._parts, self._links = [], 0

    def _pop(self, place: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self._stack) > place:
            self._where[self._stack.pop().tag].pop()

    def _start(self, tag: str, names: dict[str, str], empty: bool) -> None:
        inline = tag in INLINE or (tag not in CONTAINERS and tag not in BLOCKS and tag not in SKIPPED)
        if tag in VOID:
            if tag in ("br", "hr"):
                self._end_block()
            for group in ENDS.get(tag, ()):
                if (place := self._stack[-1].nearest[group]) >= 0:
                    self._pop(place)
            return
        if not inline:
            self._end_block()
            for group in ENDS.get(tag, ()):
                if (place := self._stack[-1].nearest[group]) >= 0:
                    self._pop(place)
            if tag in CONTAINERS and (links := self._where.get("a")) and not self._stack[-1].skipped:
                self._pop(links[-1]) if links[-1] > self._stack[-1].block else links.clear()
        elif tag == "a" and (links := self._where.get("a")) and links[-1] > self._stack[-1].block:
            self._pop(links[-1])
        if empty:
            return
        above = self._stack[-1]
        mark, hidden = _mark(tag, names)
        if tag == "header" and (self._where.get("article") or self._where.get("main")):
            mark = _Mark(0) if not mark.by_name else mark
        if tag in HEADINGS and not mark.by_name:
            mark = _Mark(0)
        if inline and not (hidden or mark.sign < 0 or self._where.get(tag) or (tag == "a" and "href" in names)):
            return
        node = above.node
        if not above.skipped and ((tag in CONTAINERS) or mark.sign):
            node = len(self.parent)
            self.parent.append(above.node)
            self.depth.append(self.depth[above.node] + 1)
            self.marks.append(mark)
            if inline:  # an advert in the middle of a line is a block by itself
                self._end_block()
        place = len(self._stack)
        nearest = tuple(place if tag in ended else -1 if tag in around else near for (ended, around), near in zip(GROUPS.values(), above.nearest))
        self._stack.append(_Open(tag, node, above.skipped or hidden or tag in SKIPPED, inline, nearest, place if tag in _SCOPE else above.scope, above.block if inline else place))
        self._where.setdefault(tag, []).append(place)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            if tag == "br":
                self._end_block()
            return
        top = self._stack[-1]
        places = self._where.get(tag)
        if not places:
            if tag == "p":
                self._end_block()
            return
        inline = self._stack[places[-1]].inline
        least = top.block if inline else (self._where.get("table") or [0])[-1] if tag in _TABLE_PARTS or tag == "table" else top.scope
        if places[-1] < least:
            return
        if not inline or self._stack[places[-1]].node != self._stack[places[-1] - 1].node:
            self._end_block()
        self._pop(places[-1])


def _name_sign(name: str) -> int:
    """What one class or id says: 1, -1 or 0."""
    words = [w for x in re.split(r"[-_]+", name.partition("--")[0]) if (w := x.rstrip("0123456789")).isalpha()]
    if STATE.intersection(words):
        return 0
    if FURNITURE.match("".join(words)):
        return -1
    if any(map(FURNITURE.match, words)):
        while words[-1] in PARTS and not FURNITURE.match(words[-1]):
            words.pop()
        return -1 if FURNITURE.match(words[-1]) else 0
    return int(any(map(BODY.match, words)))


def _mark(tag: str, names: dict[str, str]) -> tuple[_Mark, bool]:
    """What an element says about its text, and whether it is hidden."""
    mark = _Mark(-1 if tag in AGAINST else 1 if tag in FOR else 0, tag == "form", tag if tag in FOR else "")
    if not names:
        return mark, False
    hidden = "hidden" in names or names.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*+:\s*+none|visibility\s*+:\s*+hidden", names.get("style", "").lower()))
    role = names.get("role", "").lower()
    if role in ROLES_AGAINST:
        mark = _Mark(-1, role == "form")
    elif role in FOR:
        mark = _Mark(1, kind=role)
    if not mark.kind and mark.sign >= 0 and tag not in ("html", "body"):
        signs = {_name_sign(x) for key in ("class", "id") for x in names.get(key, "").lower().split()}
        if -1 in signs:
            mark = _Mark(-1, True)
        elif mark.sign == 0 and 1 in signs and tag in CONTAINERS:
            mark = _Mark(1, True)
    return mark, hidden


#: Columns of block_features.
FEATURES = "length links punctuation words before after sentence heading item menu paragraph share bulk edge inside content_name outside element name constant".split()
#: Those that say what elements and names around a block say.
TELLING = [FEATURES.index(x) for x in ("inside", "content_name", "outside", "element", "name")]


def block_features(page: Page) -> np.ndarray:
    """A row of FEATURES for each block."""
    blocks, parent, marks = page.blocks, page.parent, page.marks
    n, m = len(parent), len(blocks)
    out = np.zeros((m, len(FEATURES)))
    if not m:
        return out
    sizes = [len(b.text) for b in blocks]
    # Downwards: the nearest mark that tells, and the nearest article.
    sign, article = [0] * n, [-1] * n
    for k in range(1, n):
        up = parent[k]
        sign[k] = marks[k].sign or sign[up]
        article[k] = k if marks[k].kind == "article" else article[up]
    # Upwards: text in each container, unlinked text, text marked as content, and what it holds.
    mass, plain, content, own = [0] * n, [0] * n, [0] * n, [0] * n
    holds, nested, longest = [0] * n, [0] * n, [0] * n  # elements, text and longest text of articles
    for b, size in zip(blocks, sizes):
        mass[b.node] += size
        plain[b.node] += size - b.links
        if sign[b.node] > 0 and b.tag not in HEADINGS:
            content[b.node] += size
        if article[b.node] >= 0:
            own[article[b.node]] += size
    for k in range(n - 1, 0, -1):
        up = parent[k]
        mass[up] += mass[k]
        plain[up] += plain[k]
        content[up] += content[k]
        holds[up] |= holds[k] | (2 if marks[k].kind == "main" else 1 if marks[k].kind == "article" else 0) * (mass[k] > 0)
        is_article = marks[k].kind == "article"
        nested[up] += mass[k] if is_article else nested[k]
        longest[up] = max(longest[up], mass[k] if is_article else longest[k])
    whole, bulk = mass[0], max(1, plain[0])
    # Downwards again: what is said without wrappers, and how much of the way to the page's bulk is shared.
    said = [(False, False, False, False)] * n  # inside, content name, element against, name against
    for k in range(1, n):
        inside, good, element, name = said[parent[k]]
        mark, up = marks[k], parent[k]
        if mark.sign < 0:
            beside = content[0] - content[k]
            most = 2 * mass[k] > whole and beside < BESIDE * mass[k]
            if not (holds[k] & 2 or (holds[k] & 1 and not beside) or (mark.by_name and most)):
                name, element = name or mark.by_name, element or not mark.by_name
        elif mark.kind == "article" and article[up] >= 0 and mass[k] < own[article[up]]:
            name = True
        elif mark.sign > 0:
            inside, good = inside or bool(mark.kind), good or mark.by_name
        elif article[k] >= 0 and 0 < longest[k] < own[article[k]] and nested[k] > 0.8 * mass[k]:
            name = True  # hardly more than a list of comments
        said[k] = (inside, good, element, name)
    heavy = 0
    on_way = [False] * n
    on_way[0] = True
    child: dict[int, int] = {}
    for k in range(n - 1, 0, -1):
        if plain[k] >= plain[child.get(parent[k], k)]:
            child[parent[k]] = k
    while heavy in child and 2 * plain[child[heavy]] > bulk:
        heavy = child[heavy]
        on_way[heavy] = True
    deepest = max(1, page.depth[heavy])
    near = [0] * n
    for k in range(1, n):
        near[k] = page.depth[k] if on_way[k] else near[parent[k]]
    there = any(said[b.node][0] and not said[b.node][2] and not said[b.node][3] for b in blocks)
    for k, b in enumerate(blocks):
        size = sizes[k]
        inside, good, element, name = said[b.node]
        clear = not (element or name)
        out[k] = (
            np.log1p(size) / 8,
            b.links / size,
            min(1.0, sum(map(b.text.count, ".,;:!?。、")) / max(size, 20) * 20),
            min(1.0, (b.text.count(" ") + 1) / 40),
            np.log1p(sizes[k - 1] if k else 0) / 8,
            np.log1p(sizes[k + 1] if k + 1 < m else 0) / 8,
            b.text[-1] in ".!?…。",
            b.tag in HEADINGS,
            b.tag in ("li", "dt", "dd", "td", "th"),
            b.tag in ("li", "dt", "dd", "td", "th") and 2 * b.links > size,
            b.tag in ("p", "pre", "blockquote"),
            plain[b.node] / bulk,
            near[b.node] / deepest if heavy else 1.0,
            1 - 2 * min(k + 0.5, m - k - 0.5) / m,
            inside and clear,
            good and clear,
            there and not inside,
            element,
            name,
            1.0,
        )
    return out


def train(x: np.ndarray, content: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (weight * (p - content)) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Marks of the pieces of a made page, which are taken off before they are learned from.
_CONTENT, _OTHER = "", ""


def made_page(r: np.random.Generator, elements: bool | None = None, names: bool | None = None) -> str:
    """A page from random parts; each piece of text begins with the mark of its kind. elements, names:
    whether parts are named by their element and by class (as often as not, where None)."""
    elements = bool(r.random() < 0.6) if elements is None else elements
    names = bool(r.random() < 0.6) if names is None else names
    letters = "aeiounrstlmdkpäéß" if r.random() < 0.7 else "aeiouwhtcgfby"

    def word() -> str:
        return "".join(letters[k] for k in r.integers(0, len(letters), int(r.integers(1, 9))).tolist())

    def words(least: int, most: int) -> str:
        return " ".join(word() for _ in range(int(r.integers(least, most + 1))))

    def sentence() -> str:
        return words(3, 14).capitalize() + (", " + words(2, 8) if r.random() < 0.4 else "") + str(r.choice([".", ".", ".", "!", "?"]))

    def sentences(least: int, most: int) -> str:
        return " ".join(sentence() for _ in range(int(r.integers(least, most + 1))))

    def part(element: str, name: str, inner: str) -> str:
        tag = element if elements and element != "div" else "div"
        label = f' class="{r.choice(name.split())}"' if names and name and (tag == "div" or r.random() < 0.5) else ""
        return f"<{tag}{label}>{inner}</{tag}>"

    def links(least: int, most: int) -> str:
        items = [f'<a href="/{word()}">{_OTHER}{words(1, 3)}</a>' for _ in range(int(r.integers(least, most + 1)))]
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.7 else " ".join(items)

    def paragraph() -> str:
        kind, mark = r.random(), _CONTENT
        if kind < 0.62:
            inner = sentences(1, 7) if r.random() < 0.85 else word().capitalize() + "."
            if r.random() < 0.2:
                inner += f' <a href="/{word()}">{words(1, 4)}</a>.'
            return f"<p>{mark}{inner}</p>"
        if kind < 0.72:
            return f"<h2>{mark}{words(2, 7)}</h2>"
        if kind < 0.82:
            linked = r.random() < 0.3
            items = [f'<a href="/{word()}">{mark}{words(1, 6)}</a>' if linked else mark + (sentence() if r.random() < 0.5 else words(1, 6)) for _ in range(int(r.integers(2, 7)))]
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        if kind < 0.87:
            return f"<blockquote><p>{mark}{sentences(1, 3)}</p></blockquote>"
        if kind < 0.92:
            rows = "".join("<tr>" + "".join(f"<td>{mark}{words(1, 3)}</td>" for _ in range(3)) + "</tr>" for _ in range(int(r.integers(2, 5))))
            return f"<table>{rows}</table>"
        if kind < 0.96:
            return f"<figure><figcaption>{mark}{sentence()}</figcaption></figure>"
        return f"<div>{mark}{sentences(1, 4)}</div>"

    advert = lambda: part("div", "ad ads advert sponsor promo-box banner", f"{_OTHER}{sentences(1, 2)}" if r.random() < 0.7 else f"<p>{_OTHER}{sentences(1, 2)}</p>")
    size = int(np.exp(r.uniform(0, 3.4)))
    body = [paragraph() for _ in range(size)] if r.random() < 0.9 else [f"<p>{_CONTENT}{words(1, 3)}"]
    if r.random() < 0.15:
        body.insert(int(r.integers(0, len(body) + 1)), part("aside", "share social related newsletter", f"{_OTHER}{words(1, 4)}" if r.random() < 0.5 else links(2, 5)))
    if r.random() < 0.15:
        body.insert(int(r.integers(0, len(body) + 1)), advert()) if names else None
    title = f"<h1>{_CONTENT}{words(2, 9)}</h1>" if r.random() < 0.8 else ""
    if title and elements and r.random() < 0.3:
        title = f"<header>{title}</header>"
    text = part(str(r.choice(["article", "main"])), "content post entry story article-body main", title + "".join(body))
    replies = "".join(part("article", "", f"<p>{_OTHER}{sentences(1, 4)}</p>") for _ in range(int(r.integers(1, 7))))
    comments = part("section", "comments comments-area reader-comments replies", replies)
    if size > 5 and r.random() < 0.4:
        if elements and text.startswith("<article"):  # where HTML has comments
            text = text[: text.rindex("</")] + comments + text[text.rindex("</") :]
        elif names and not elements:
            text += comments
    before = [part("header", "header site-header masthead", f"<h2>{_OTHER}{words(1, 3)}</h2>" if r.random() < 0.5 else f"{_OTHER}{words(1, 4)}"), part("nav", "menu nav top-menu", links(2, 10))]
    before += [part("div", "cookie-notice notice alert", f"{_OTHER}{sentences(1, 2)}")] * int(r.random() < 0.4) + [advert()] * int(r.random() < 0.5)
    before += [part("form", "search login", f"<label>{_OTHER}{words(1, 2)}</label><input>")] * int(r.random() < 0.3)
    after = [part("aside", "sidebar related widget", f"<h3>{_OTHER}{words(1, 3)}</h3>" + (links(2, 8) if r.random() < 0.7 else f"<p>{_OTHER}{sentences(1, 2)}</p>"))] * int(r.random() < 0.6) + [advert()] * int(r.random() < 0.3)
    after += [part("footer", "footer site-footer copyright", f"{_OTHER}&copy; {words(1, 4)} &middot; {sentence()}" if r.random() < 0.6 else f"<p>{_OTHER}&copy; {words(1, 3)}</p>{links(1, 6)}")]
    page = "".join(before[int(r.integers(0, 2)) :]) + text + "".join(after)
    for _ in range(int(r.integers(0, 3))):
        wrapper = str(r.choice(["", "page", "wrap", "container", "has-sidebar", "content sidebar-right"])) if names else ""
        page = f'<div class="{wrapper}">{page}</div>' if wrapper else f"<div>{page}</div>"
    return f"<html><head><title>{words(1, 5)}</title></head><body>{page}</body></html>"


def made_blocks(page: str) -> tuple[Page, np.ndarray]:
    """The page read, and which of its blocks are content."""
    found = Page(page)
    content = np.array([b.text.startswith(_CONTENT) for b in found.blocks], float)
    for b in found.blocks:
        b.text = b.text.replace(_CONTENT, "").replace(_OTHER, "").strip() or "-"
        b.links = min(b.links, len(b.text))
    return found, content


@lru_cache(maxsize=2)
def made_rows(pages: int = MADE_PAGES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    xs, ys = zip(*((block_features(p), y) for p, y in (made_blocks(made_page(r)) for _ in range(pages))))
    return np.concatenate(xs), np.concatenate(ys)


def balanced(content: np.ndarray) -> np.ndarray:
    """Weights of rows that give both kinds the same total."""
    share = content.mean() if len(content) else 0.5
    return np.where(content > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9)) if 0 < share < 1 else np.zeros(len(content))


@lru_cache(maxsize=1)
def made_weights() -> np.ndarray:
    """Weights learned from made pages alone."""
    return fit(np.zeros((0, len(FEATURES))), np.zeros(0))


def fit(x: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Weights learned from made pages and blocks of the table's own, which weigh as much at most. Own
    blocks of one kind only tell nothing."""
    made_x, made_y = made_rows()
    own = balanced(content) * min(1.0, len(made_x) / max(1, len(x)))
    return train(np.concatenate([made_x, x]), np.concatenate([made_y, content]), np.concatenate([balanced(made_y), own]))


def max_flow(n: int, edges: list[tuple[int, int, float, float]], source: int, sink: int) -> list[bool]:
    """Which of n nodes are on the source's side of a minimum cut (Dinic). edges: u, v, capacity from
    u to v and back."""
    to, room, out = [], [], [[] for _ in range(n)]
    for u, v, forth, back in edges:
        out[u].append(len(to))
        to.append(v)
        room.append(forth)
        out[v].append(len(to))
        to.append(u)
        room.append(back)
    tiny = 1e-9
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        nxt = [0] * n
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least = min(room[e] for e in path)
                for k in range(len(path) - 1, -1, -1):
                    room[path[k]] -= least
                    room[path[k] ^ 1] += least
                    if room[path[k]] <= tiny:
                        cut = k
                u = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while nxt[u] < len(out[u]):
                e = out[u][nxt[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            else:
                if u == source:
                    break
                level[u] = -1
                e = path.pop()
                u = to[e ^ 1]
                nxt[u] += 1
                continue
            path.append(e)
            u = to[e]


def smoothness(page: Page) -> list[tuple[int, int, float]]:
    """Edges between blocks, and what it costs to label their ends differently."""
    edges, last = [], {}
    for k, b in enumerate(page.blocks):
        if k:
            u, v = page.blocks[k - 1].node, b.node
            deepest = max(1, page.depth[u], page.depth[v])
            while u != v:
                if page.depth[u] >= page.depth[v]:
                    u = page.parent[u]
                else:
                    v = page.parent[v]
            edges.append((k - 1, k, NEXT * page.depth[u] / deepest))
        if (j := last.get(b.node)) is not None:
            edges.append((j, k, SIBLING))
        last[b.node] = k
    return edges


def odds_of(page: Page, weights: np.ndarray) -> np.ndarray:
    return np.clip(block_features(page) @ weights, -RANGE, RANGE)


def label(odds: np.ndarray, edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which blocks are content: the source's side of the minimum cut.

    Being boilerplate costs -log(1 - p), being content -log(p), of which the smaller is paid in any case. A block
    whose odds outweigh all its edges is settled by them; its edges become capacities of its neighbours, and
    so on. Neither changes the least cost. What is left is cut by a maximum flow."""
    n = len(odds)
    if not n:
        return []
    gain = [float(x) for x in odds]  # log(p) - log(1 - p), what is paid on top for the other label
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for u, v, w in edges:
        around[u][v] = around[u].get(v, 0.0) + w
        around[v][u] = around[v].get(u, 0.0) + w
    settled: list[bool | None] = [None] * n
    queue = deque(range(n))
    while queue:
        k = queue.popleft()
        if settled[k] is None and abs(gain[k]) > sum(around[k].values()):
            settled[k] = gain[k] > 0
            for j, w in around[k].items():
                del around[j][k]
                gain[j] += w if settled[k] else -w
                queue.append(j)
    left = [k for k in range(n) if settled[k] is None]
    if left:
        at = {k: i for i, k in enumerate(left)}
        source, sink = len(left), len(left) + 1
        flow = [(source, i, gain[k], 0.0) if gain[k] > 0 else (i, sink, -gain[k], 0.0) for k, i in at.items()]
        flow += [(at[k], at[j], w, w) for k in left for j, w in around[k].items() if k < j]
        for k, side in zip(left, max_flow(len(left) + 2, flow, source, sink)):
            settled[k] = side
    return [bool(x) for x in settled]


def main_text(html: str, weights: np.ndarray | None = None) -> str:
    page = Page(html)
    keep = label(odds_of(page, made_weights() if weights is None else weights), smoothness(page))
    return " ".join(b.text for b, k in zip(page.blocks, keep) if k)


def learn(pages: DataFrame, most: int = TRAIN_PAGES, blocks: int = TRAIN_BLOCKS) -> np.ndarray:
    """Weights from made pages and a bounded number of the table's: their blocks are labelled by the
    elements they stand in, and what elements and names say is left out of their features."""
    order = F.xxhash64(F.lit("pages"), "page_id", "url")
    known = pages.where("html IS NOT NULL")
    some = known.select(order.alias("h")).distinct().orderBy("h").limit(most)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        inside, element, name = (FEATURES.index(x) for x in ("inside", "element", "name"))
        for h, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = block_features(Page(html))
            kind = x[:, inside] - x[:, element]
            tells = (kind != 0) & (x[:, name] == 0)
            x[:, TELLING] = 0
            rows += [(h, k, float(kind[k] > 0), x[k].tolist()) for k in np.flatnonzero(tells).tolist()]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.list_(pa.float64())))], ["h", "k", "content", "x"])

    rows = known.select(order.alias("h"), "html").join(F.broadcast(some), "h", "left_semi")
    found = over_batches(rows, work, "h long, k int, content double, x array<double>").orderBy("h", "k", "x").limit(blocks).select("x", "content").collect()
    return fit(np.array([r.x for r in found]).reshape(len(found), len(FEATURES)), np.array([r.content for r in found]))


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    tune(pages.sparkSession, 500)
    weights = learn(pages) if weights is None else weights

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x or "", weights) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return over_batches(rows, work, "page_id long, url string, text string, n_chars long")
