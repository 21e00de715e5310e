"""A page as a list of nodes in page order, and the features of each.

The reader is forgiving: it closes what HTML closes by itself, skips raw text elements, and
never fails. Nodes are the elements that can hold a block of text, and inline elements with a
class, an id or a role; text belongs to the innermost node around it and to a block, which ends
wherever a block element begins or ends.
"""

from __future__ import annotations

import html
import re

import numpy as np

# Element names of HTML, by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp template noscript svg math object canvas audio video select".split())
# Of these, an element without an end tag takes in the rest of the page; of the others above, only its start tag goes.
RUNS_ON = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
CLOSED_BY_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol dl table tbody thead tfoot tr body html article div section main nav aside header footer form".split())
TAG_GROUPS = (
    "article main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "nav", "header", "footer", "aside", "form fieldset button label legend",
    "table tbody thead tr td th", "blockquote pre figure figcaption details", "body html",
)
TOKEN_GROUPS = (
    "article content post entry story text body main blog page prose",
    "ad ads adv advert advertisement adsense banner promo promotion promoted sponsor sponsored",
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip",
    "comment comments commentlist reply replies respond discussion discuss disqus responses feedback review reviews",
    "sidebar aside side rail widget widgets complementary related recommended recommendations popular trending more",
    "cookie cookies consent gdpr notice notices notification alert alertdialog popup modal overlay dialog warning message privacy hidden",
    "footer foot bottom copyright legal colophon contentinfo credits",
    "header head masthead topbar top logo branding brand tagline",
    "form search login signin signup register subscribe subscription newsletter contact poll survey",
    "share sharing social tags tag meta byline author date breadcrumb print",
)

TAG_OF = {tag: i for i, group in enumerate(TAG_GROUPS) for tag in group.split()}
TOKEN_OF: dict[str, list[int]] = {}
for _i, _group in enumerate(TOKEN_GROUPS):
    for _token in _group.split():
        TOKEN_OF.setdefault(_token, []).append(_i)

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
#: The mark of pages whose main text is known; it is no feature.
MARK = re.compile(r'data-main="([01])"')
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def token_groups(attributes: str) -> tuple[int, ...]:
    """Groups of the tokens in an element's class, id, role and label."""
    found: set[int] = set()
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found.update(TOKEN_OF["hidden"])
        elif name not in ("style", "aria-hidden"):
            for token in SPLIT.split(CAMEL.sub("-", value).lower()):
                found.update(TOKEN_OF.get(token, ()))
    return tuple(found)


class Page:
    """Nodes in page order: tag, parent, end of the subtree, token groups; and pieces of text: node, block, in a link, text."""

    def __init__(self, source: str):
        self.tags: list[str] = ["#page"]
        self.parents: list[int] = [-1]
        self.ends: list[int] = [0]
        self.groups: list[tuple[int, ...]] = [()]
        self.children: list[int] = [0]
        self.marks: list[str | None] = [None]
        self.pieces: list[tuple[int, int, bool, str]] = []
        self._stack: list[tuple[str, int]] = [("#page", 0)]
        self._open: dict[str, int] = {}
        self._block = 0
        self._read(source)
        while len(self._stack) > 1:
            self._pop()
        self.ends[0] = len(self.tags)

    def _pop(self) -> str:
        tag, node = self._stack.pop()
        self._open[tag] -= 1
        if node != self._stack[-1][1]:
            self.ends[node] = len(self.tags)
        if tag not in INLINE:
            self._block += 1
        return tag

    def _pop_to(self, tags: tuple[str, ...], walls: frozenset[str]) -> None:
        """Close up to the innermost of `tags`, unless a wall stands before it."""
        for k in range(len(self._stack) - 1, 0, -1):
            tag = self._stack[k][0]
            if tag in tags:
                while len(self._stack) > k:
                    self._pop()
                return
            if tag in walls:
                return

    def _text(self, text: str) -> None:
        if text and not text.isspace():
            self.pieces.append((self._stack[-1][1], self._block, self._open.get("a", 0) > 0, html.unescape(text) if "&" in text else text))
        elif text and self.pieces and self.pieces[-1][1] == self._block:
            self.pieces.append((self._stack[-1][1], self._block, False, " "))

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text(" ")
        if tag not in INLINE:
            self._block += 1
        if tag in VOID:
            return
        if tag in CLOSES_P and self._open.get("p"):
            self._pop_to(("p",), HOLDS)
        if tag in CLOSED_BY_SAME and any(self._open.get(t) for t in CLOSED_BY_SAME[tag]):
            self._pop_to(CLOSED_BY_SAME[tag], frozenset(("ul", "ol", "dl", "table", "select")))
        groups = token_groups(attributes) if attributes else ()
        node = self._stack[-1][1]
        if tag not in INLINE or groups:
            self.children[node] += 1
            self.tags.append(tag)
            self.parents.append(node)
            self.groups.append(groups)
            self.marks.append(m[1] if "data-main" in attributes and (m := MARK.search(attributes)) else None)
            self.children.append(0)
            self.ends.append(0)
            node = len(self.tags) - 1
        self._stack.append((tag, node))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _end(self, tag: str) -> None:
        if self._open.get(tag):
            inline = tag in INLINE
            for k in range(len(self._stack) - 1, 0, -1):
                if self._stack[k][0] == tag:
                    while len(self._stack) > k:
                        self._pop()
                    return
                if inline and self._stack[k][0] not in INLINE:
                    return  # an inline end tag closes no block

    def _read(self, source: str) -> None:
        at, n = 0, len(source)
        never_closed: set[str] = set()
        while at < n:
            m = MARKUP.search(source, at)
            if m is None:
                break
            self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._end(tag)
            elif tag in RAW:
                if not m[3].endswith("/") and tag not in never_closed:
                    close = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(source, at)
                    if close:
                        at = close.end()
                    elif tag in RUNS_ON:
                        at = n
                    else:
                        never_closed.add(tag)
                if tag not in ("svg", "math", "script"):
                    self._block += 1
            elif tag == "head":
                close = re.compile(r"</head\b|<body\b", re.I).search(source, at)
                at = close.start() if close else at
            else:
                self._start(tag, m[3])
        rest = source[at:]
        cut = rest.find("<")  # a tag that the end of the page cut off
        while 0 <= cut and not (rest[cut + 1 : cut + 2].isalpha() or rest[cut + 1 : cut + 2] in ("/", "!", "?")):
            cut = rest.find("<", cut + 1)
        self._text(rest if cut < 0 else rest[:cut])


N_TAGS, N_TOKENS = len(TAG_GROUPS), len(TOKEN_GROUPS)
PUNCTUATION = re.compile(r"[.,;:!?]")


def features(pages: list[Page]) -> np.ndarray:
    """A row for every node of every page, in order."""
    first = np.cumsum([0, *(len(p.tags) for p in pages)])
    n = int(first[-1])
    page = np.repeat(np.arange(len(pages)), np.diff(first))
    tag = np.array([TAG_OF.get(t, N_TAGS) for p in pages for t in p.tags])
    ends = np.concatenate([np.array(p.ends) + f for p, f in zip(pages, first, strict=False)]) if n else np.zeros(0, int)
    parents = np.concatenate([np.where(np.array(p.parents) < 0, 0, p.parents) + f for p, f in zip(pages, first, strict=False)]) if n else np.zeros(0, int)
    children = np.array([c for p in pages for c in p.children])
    tokens = np.zeros((n, N_TOKENS))
    for p, f in zip(pages, first, strict=False):
        for i, groups in enumerate(p.groups):
            if groups:
                tokens[f + i, groups] = 1
    own = np.zeros((n, 3))  # characters, in links, punctuation
    for p, f in zip(pages, first, strict=False):
        for node, _, linked, text in p.pieces:
            size = len(text)
            own[f + node] += (size, size if linked else 0, len(PUNCTUATION.findall(text)))

    def below(x: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0)])
        return sums[ends] - sums[np.arange(n)]

    def above(x: np.ndarray) -> np.ndarray:
        """Sum over a node and its ancestors."""
        steps = np.zeros((n + 1, *x.shape[1:]))
        steps[:n] += x
        np.subtract.at(steps, ends, x)
        return np.cumsum(steps, axis=0)[:n]

    tags = np.zeros((n, N_TAGS + 1))
    tags[np.arange(n), tag] = 1
    sums = below(own)
    chars = np.maximum(sums[:, 0], 1)
    elements = below(np.ones(n))
    kinds = below(tags)
    total = np.maximum(sums[first[page], 0], 1)
    starts = (np.cumsum(own[:, 0]) - own[:, 0]) - (np.cumsum(own[:, 0]) - own[:, 0])[first[page]]
    depth = above(np.ones(n))
    brothers = np.maximum(children[parents], 1)
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i, p in enumerate(parents.tolist()):
        order[i] = seen.get(p, 0)
        seen[p] = order[i] + 1
    same = np.bincount(parents * (N_TAGS + 1) + tag, minlength=n * (N_TAGS + 1)).reshape(n, N_TAGS + 1)[parents, tag]
    depth_of_page = np.ones(len(pages))
    np.maximum.at(depth_of_page, page, depth)
    return np.column_stack([
        tags[:, :N_TAGS],
        above(tags[:, :N_TAGS])[:, [0, 3, 5, 7, 8, 9, 10, 11]],
        kinds[:, [0, 3, 4, 6, 7, 9, 11]],
        tokens,
        above(tokens),
        below(tokens)[:, :4] - tokens[:, :4],
        np.log1p(sums[:, 0]),
        sums[:, 1] / chars,
        sums[:, 2] / chars,
        sums[:, 0] / elements,
        sums[:, 0] / total,
        sums[:, 0] / np.maximum(sums[parents, 0], 1),
        np.log1p(own[:, 0]),
        starts / total,
        depth,
        depth / depth_of_page[page],
        order / brothers,
        brothers,
        same / brothers,
        np.log1p(sums[parents, 0] / brothers),
        children,
    ])
