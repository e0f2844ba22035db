"""Pages as small trees: parsing, shapes, and simple tree matching."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

# Elements of HTML by what they do to the text around them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var".split()
)
RAW = "script|style|noscript|template|svg|math|iframe|object|canvas|audio|video|textarea|title|select"
#: Those that end at the first end tag or with the page; others nest, and not closed only their tag goes.
RAW_TO_END = {"script", "style", "textarea", "title"}
#: What a start tag closes if it is open right above it.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"},
}
#: What a node says of itself: nothing, by class, id or form that it is beside the article
#: (a wrapper may say so too), or by element, role or being hidden that it is.
SOFT, HARD = 1, 2
#: Elements and roles that never hold an article, but that a form may be round the page.
ASIDE_TAGS = set("nav footer aside form button fieldset dialog menu head datalist legend".split())
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of classes and ids that name what stands around an article.
ASIDE_WORDS = set(
    "ad ads adv advert advertisement adsense adslot banner sponsor sponsored promo promotion menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar widget widgets footer masthead topbar toolbar cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login search share "
    "sharing social related recommended comment comments disqus reply replies respond pagination pager copyright "
    "disclaimer skip".split()
)
NEVER_ASIDE = {"html", "body", "article", "main"}
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({RAW})(?=[\s/>])(?:(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>|[^>]*>)"
    r"|<(/?)([a-z][a-z0-9:-]*)((?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>|[^<]+|<",
    re.S | re.I,
)
_RAW_TAG = {
    tag: re.compile(rf"<(/?){tag}(?=[\s/>])(?:(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+>|[^>]*>)", re.I) for tag in RAW.split("|")
}
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW_TO_END}
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def _remembered(fn):
    """Results of the last calls, kept by whoever runs the function: it travels with its task."""
    held: dict = {}

    def run(*key):
        if key not in held:
            if len(held) >= 1 << 12:
                held.clear()
            held[key] = fn(*key)
        return held[key]

    return run


@dataclass
class Node:
    tag: str
    label: str
    aside: int
    parent: int
    children: list[int] = field(default_factory=list)


@dataclass
class Page:
    """Nodes in document order, and blocks of text as (node, text)."""

    nodes: list[Node]
    blocks: list[tuple[int, str]]


@_remembered
def _described(tag: str, attributes: str) -> tuple[str, int]:
    """(label, whether it names itself as something beside the article: 0, SOFT or HARD)."""
    names = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMES.finditer(attributes)}
    words = [w.lower() for k in ("class", "id") for w in _PART.findall(names.get(k, ""))]
    role = names.get("role", "").lower()
    aside = 0
    if tag not in NEVER_ASIDE:
        if (tag in ASIDE_TAGS and tag != "form") or (role in ASIDE_ROLES and role != "form") or _HIDDEN.search(attributes):
            aside = HARD
        elif tag == "form" or role == "form" or not ASIDE_WORDS.isdisjoint(words):
            aside = SOFT
    return ".".join([tag, *words]), aside


def _closed(html: str, raw: str) -> dict[int, int]:
    """Where every element of this kind begins that has an end tag of its own, and that one's end."""
    found, open_ = {}, []
    for m in _RAW_TAG[raw].finditer(html, 0, html.rfind(">") + 1):
        if not m[1]:
            if raw not in ("svg", "math") or not m[0].endswith("/>"):
                open_.append(m.start())
        elif open_:
            found[open_.pop()] = m.end()
    return found


def parse(html: str) -> Page:
    """The tree of block elements; inline ones are text, and what is not closed ends late."""
    nodes = [Node("", "", 0, -1)]
    blocks: list[tuple[int, str]] = []
    open_, text = [0], []

    def flush() -> None:
        if text:
            words = " ".join(unescape("".join(text)).split())
            text.clear()
            if words:
                blocks.append((open_[-1], words))

    # every character up to the last end of a tag is in a token; behind it is text
    at, closed, last = 0, {}, html.rfind(">") + 1
    while m := _TOKEN.match(html, at, last):
        at, name = m.end(), m[3]
        if name is None:
            part = m[0]
            if at == last and part.startswith("<!--") and not part.endswith("-->"):
                at = len(html)
            elif part[0] != "<" or len(part) == 1:
                text.append(part)
            elif m[1] is not None:
                flush()
                raw = m[1].lower()
                if raw in RAW_TO_END:
                    end = _RAW_END[raw].search(html, at)
                    at = end.end() if end else len(html)
                else:
                    if raw not in closed:
                        closed[raw] = _closed(html, raw)
                    at = closed[raw].get(m.start(), at)
            continue
        tag = name.lower()
        if tag in ("br", "wbr", "hr", "img", "input"):
            if tag == "hr":
                flush()
            elif tag != "wbr":
                text.append(" ")
            continue
        if tag in VOID:
            continue
        if m[2]:
            if tag in INLINE and nodes[open_[-1]].tag != tag:
                continue
            for i in range(len(open_) - 1, 0, -1):
                if nodes[open_[i]].tag == tag:
                    flush()
                    del open_[i:]
                    break
            continue
        label, aside = _described(tag, m[4])
        if tag in INLINE and not aside:
            continue
        flush()
        if tag not in INLINE:
            while len(open_) > 1 and (nodes[open_[-1]].tag in CLOSES.get(tag, ()) or nodes[open_[-1]].tag == "p"):
                open_.pop()
        if m[4].endswith("/") and tag in ("div", "p", "span"):
            continue
        nodes.append(Node(tag, label, aside, open_[-1]))
        nodes[open_[-1]].children.append(len(nodes) - 1)
        open_.append(len(nodes) - 1)
    rest = html[max(at, last) :]
    comment = rest.find("<!--")
    text.append(rest if comment < 0 else rest[:comment])
    flush()
    return Page(nodes, blocks)


def shape(page: Page) -> tuple[str, list[int]]:
    """The tree's labels with runs of equal siblings as one, and each node's number there.

    Numbers are in document order of the shape; equal siblings share theirs.
    """
    texts = [""] * len(page.nodes)
    for i in range(len(page.nodes) - 1, -1, -1):
        inner: list[str] = []
        for c in page.nodes[i].children:
            if not inner or inner[-1] != texts[c]:
                inner.append(texts[c])
        texts[i] = f"({page.nodes[i].label}{''.join(inner)})"
    number = [0] * len(page.nodes)
    count = 0
    stack = [(0, -1)]
    while stack:  # document order; a repeat takes the numbers of the sibling before it
        i, like = stack.pop()
        if like < 0:
            number[i] = count
            count += 1
        else:
            number[i] = number[like]
        children = page.nodes[i].children
        pairs = []
        if like >= 0:
            own, theirs = _runs(children, texts), _runs(page.nodes[like].children, texts)
            pairs = [(c, b[0]) for a, b in zip(own, theirs, strict=True) for c in a]
        else:
            for run in _runs(children, texts):
                pairs += [(run[0], -1), *[(c, run[0]) for c in run[1:]]]
        stack.extend(reversed(pairs))
    return texts[0], number


def _runs(children: list[int], texts: list[str]) -> list[list[int]]:
    out: list[list[int]] = []
    for c in children:
        if out and texts[out[-1][0]] == texts[c]:
            out[-1].append(c)
        else:
            out.append([c])
    return out


def read_shape(text: str) -> list[tuple[str, list[int]]]:
    """(label, children) in document order."""
    out: list[tuple[str, list[int]]] = []
    stack: list[int] = []
    for m in re.finditer(r"\(([^()]*)|\)", text):
        if m[0] == ")":
            stack.pop()
            continue
        out.append((m[1], []))
        if stack:
            out[stack[-1]][1].append(len(out) - 1)
        stack.append(len(out) - 1)
    return out


@_remembered
def align(reference: str, text: str) -> tuple[int, ...]:
    """Simple tree matching: for every node of ``text`` its node in ``reference``, or -1.

    Nodes match under matching parents, in order, if their labels are equal; the
    matching is the largest.
    """
    a, b = read_shape(reference), read_shape(text)
    if a[0][0] != b[0][0]:
        return tuple([-1] * len(b))
    inside = _subtrees(a), _subtrees(b)
    found = [-1] * len(b)
    pairs, at, ends = [(0, 0)], 0, {}
    while at < len(pairs):  # a pair of nodes has one pair of parents: each comes once
        i, j = pairs[at]
        at += 1
        left, right = a[i][1], b[j][1]
        # equal siblings at either end belong together
        first = 0
        while first < min(len(left), len(right)) and inside[0][left[first]] == inside[1][right[first]]:
            first += 1
        stop = 0
        while stop < min(len(left), len(right)) - first and inside[0][left[-1 - stop]] == inside[1][right[-1 - stop]]:
            stop += 1
        ends[i, j] = first, stop
        middle = left[first : len(left) - stop], right[first : len(right) - stop]
        pairs += [(p, q) for p in middle[0] for q in middle[1] if a[p][0] == b[q][0]]
    weight: dict[tuple[int, int], int] = {}
    tables: dict[tuple[int, int], list[list[int]]] = {}
    for i, j in reversed(pairs):
        first, stop = ends[i, j]
        left, right = a[i][1], b[j][1]
        left, right = left[first : len(left) - stop], right[first : len(right) - stop]
        m = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
        for x, p in enumerate(left, 1):
            above, row = m[x - 1], m[x]
            for y, q in enumerate(right, 1):
                row[y] = max(above[y], row[y - 1], above[y - 1] + weight.get((p, q), 0))
        tables[i, j] = m
        equal = [*a[i][1][:first], *a[i][1][len(a[i][1]) - stop :]]
        weight[i, j] = m[-1][-1] + 1 + sum(inside[0][p][1] for p in equal)
    todo = [(0, 0)]
    while todo:
        i, j = todo.pop()
        found[j] = i
        if (i, j) not in tables:  # inside of equal siblings
            todo += zip(a[i][1], b[j][1], strict=True)
            continue
        first, stop = ends[i, j]
        left, right = a[i][1], b[j][1]
        todo += zip(left[:first], right[:first], strict=True)
        todo += zip(left[len(left) - stop :], right[len(right) - stop :], strict=True)
        left, right = left[first : len(left) - stop], right[first : len(right) - stop]
        m, x, y = tables[i, j], len(left), len(right)
        while x and y:
            if m[x][y] == m[x - 1][y]:
                x -= 1
            elif m[x][y] == m[x][y - 1]:
                y -= 1
            else:
                x, y = x - 1, y - 1
                todo.append((left[x], right[y]))
    return tuple(found)


def _subtrees(nodes: list[tuple[str, list[int]]]) -> list[tuple[int, int]]:
    """(hash, nodes) of every subtree; children come after their parents."""
    out = [(0, 0)] * len(nodes)
    for i in range(len(nodes) - 1, -1, -1):
        label, children = nodes[i]
        told = label.encode() + b"".join(out[c][0].to_bytes(16, "big") for c in children)
        out[i] = xxhash.xxh3_128_intdigest(told), 1 + sum(out[c][1] for c in children)
    return out


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def slots(page: Page, number: list[int]) -> list[tuple[int, int]]:
    """(node of the shape, hash of a text in it), each once.

    Equal siblings are one node of the shape, but every text of theirs is told apart: a
    fixed line among varying ones is found as such.
    """
    return sorted({(number[node], text_hash(text)) for node, text in page.blocks})


def _wrappers(page: Page, mass: list[int], marks: list[bool], enough: float) -> set[int]:
    """Nodes that are SOFT and yet wrap what they should stand beside.

    ``mass`` is the text of each node, ``marks`` the nodes to be found: the outermost
    that wraps most is taken until more than ``enough`` of the marked text is free.
    """
    size = len(page.nodes)
    held = [m if k else 0 for m, k in zip(mass, marks, strict=True)]
    for i in range(size - 1, 0, -1):
        held[page.nodes[i].parent] += held[i]
    found: set[int] = set()
    free, outermost, todo = held[0], [], [0]
    while True:
        while todo:  # down to the next SOFT nodes
            for c in page.nodes[todo.pop()].children:
                if page.nodes[c].aside == SOFT:
                    outermost.append(c)
                    free -= held[c]
                else:
                    todo.append(c)
        best = max(outermost, key=lambda c: (held[c], -c), default=0)
        if not best or not held[best] or free > enough * held[0]:
            return found
        found.add(best)
        outermost.remove(best)
        free += held[best]
        todo.append(best)


def article(page: Page, number: list[int], constant: set[tuple[int, int]], sure: bool = True) -> str:
    """The blocks of the article, two line breaks between them.

    ``constant`` are texts of the site's template: a node of the shape and the hash of a
    text there. If that is not ``sure``, they are only left out while most of the text stays: pages that share
    more are copies of one story. Article and main
    elements bound the text if there are any with text. A class, id or form speaks for
    all below it, unless a main is below, or no article stands outside of such nodes,
    or, on a page without articles, half of the text does not.
    """
    size = len(page.nodes)
    hard, home, story, inside = [False] * size, [0] * size, [0] * size, [False] * size
    for i in range(1, size):  # parents come first
        node = page.nodes[i]
        inside[i] = inside[node.parent] or node.tag in ("article", "main")
        header = node.tag == "header" and not inside[i]
        hard[i] = hard[node.parent] or node.aside == HARD or header
        own = node.tag in ("article", "main") and not node.aside
        home[i] = i if own else home[node.parent]
        story[i] = i if own and node.tag == "article" else story[node.parent]
    mass = [0] * size
    fixed = [bool(constant) and (number[n], text_hash(t)) in constant for n, t in page.blocks]
    for (n, t), same in zip(page.blocks, fixed, strict=True):
        if not hard[n] and not same:
            mass[n] += len(t)
    wraps: set[int] = set()
    main = [False] * size
    for i in range(1, size):
        own = page.nodes[i].tag == "main" and not hard[i]
        main[i] = own or main[page.nodes[i].parent]
        if own:
            while i and i not in wraps:
                wraps.add(i)
                i = page.nodes[i].parent
    if any(m and k for m, k in zip(mass, main, strict=True)):  # then all else is beside it
        mass = [m if k else 0 for m, k in zip(mass, main, strict=True)]
    freed = Page([Node(n.tag, n.label, 0 if i in wraps else n.aside, n.parent, n.children) for i, n in enumerate(page.nodes)], [])
    if any(n.aside == SOFT for n in freed.nodes):
        if any(m and k for m, k in zip(mass, story, strict=True)):
            # an article stands for itself: what is SOFT inside of it wraps nothing
            texts = [0] * size
            for i, m in enumerate(mass):
                texts[story[i]] += m
            texts[0] = 0
            wraps |= _wrappers(freed, texts, [bool(t) for t in texts], 0.0)
        else:
            homes = any(m and k for m, k in zip(mass, home, strict=True))
            wraps |= _wrappers(freed, mass, [bool(h) or not homes for h in home], 0.5)
    aside = hard
    for i in range(1, size):
        aside[i] = aside[i] or aside[page.nodes[i].parent] or (page.nodes[i].aside == SOFT and i not in wraps)
    kept = [(n, t) for (n, t), same in zip(page.blocks, fixed, strict=True) if not aside[n] and not same]
    if any(home[n] for n, _ in kept):
        kept = [(n, t) for n, t in kept if home[n]]
    text = "\n\n".join(t for _, t in kept)
    if sure or not constant:
        return text
    whole = article(page, number, set())
    return whole if 2 * len(text) < len(whole) else text
