"""A small, forgiving HTML reader: the element tree of a page and its blocks of text."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html import unescape

import xxhash

_TAG = re.compile(r"<(?:(?P<comment>!--)|(?P<decl>[!?])|(?P<close>/)?(?P<name>[a-zA-Z][^\s/>]*+))")
# attributes up to the end of the tag or to a quoted value
_PLAIN = re.compile(r"(?:[^>\"'=]++|[\"']|=\s*+(?![\"']))*+")
_EQUALS = re.compile(r"=\s*+")
# the values that are looked into
_READ = re.compile(r"\b(?:class|id|role|hidden)\s*$", re.I)
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed svg".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr input "
    # formulas stand in their line of text
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot msub msup msubsup munder mover munderover "
    "mmultiscripts mpadded mphantom mstyle mtable mtr mtd semantics annotation".split()
)
# an opening tag of these ends an open element of the same family
_ENDS = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th"),
}
_SCOPE = frozenset("ul ol dl table body article main section div td th".split())

NOISE_TAGS = frozenset("head nav footer aside form menu button select option dialog object".split())
NOISE_ROLES = frozenset(
    "navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar "
    "toolbar tooltip".split()
)
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu sidebar footer breadcrumb breadcrumbs cookie cookies consent gdpr notice "
    "newsletter subscribe subscription signup share sharing social related recommended comment "
    "comments respond disqus reply replies widget popup modal login search pagination pager toolbar "
    "masthead skip".split()
)
HEAD_WORDS = frozenset(("header", "topbar"))
MAIN_WORDS = frozenset(("article", "entry", "post", "story", "content", "main", "body", "text"))
CONTENT_TAGS = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tr td th figure "
    "figcaption".split()
)


@dataclass
class Page:
    """Elements in document order; index 0 is the root."""

    parent: list[int] = field(default_factory=lambda: [-1])
    tag: list[str] = field(default_factory=lambda: ["#root"])
    key: list[int] = field(default_factory=lambda: [0])
    declared_noise: list[bool] = field(default_factory=lambda: [False])
    in_main: list[bool] = field(default_factory=lambda: [False])
    # direct children in order, by label hash: the presentation of the element
    children: list[list[int]] = field(default_factory=lambda: [[]])
    # (element that holds the text, text)
    blocks: list[tuple[int, str]] = field(default_factory=list)


_keys: dict[tuple, int] = {}


def _key(parent: int, label: str) -> int:
    found = _keys.get((parent, label))
    if found is None:
        if len(_keys) > 500_000:
            _keys.clear()
        found = xxhash.xxh64_intdigest(f"{parent}/{label}".encode()) - (1 << 63)
        _keys[parent, label] = found
    return found


def _noise(tag: str, names: set[str], role: str, in_main: bool) -> bool:
    if tag in NOISE_TAGS or role in NOISE_ROLES:
        return True
    if tag in ("body", "html", "article", "main") and not names & {"comment", "comments", "reply"}:
        return False
    if names & NOISE_WORDS:
        return True
    heading = tag == "header" or bool(names & HEAD_WORDS)
    return heading and not in_main and not names & MAIN_WORDS


class _Quotes:
    """Ends of tags; a quoted value may hold ">" and have any length."""

    def __init__(self, html: str) -> None:
        self.html = html
        self.last_end = html.rfind(">")
        # by quote sign: from here on there is none
        self.none_from = {'"': len(html), "'": len(html)}

    def _closing(self, at: int) -> int:
        """Place of the sign that closes the quote at ``at``, or -1."""
        sign = self.html[at]
        if at + 1 >= self.none_from[sign]:
            return -1
        found = self.html.find(sign, at + 1)
        if found < 0:
            self.none_from[sign] = at + 1
        return found

    def end_of_tag(self, at: int) -> tuple[int, str] | None:
        """The place after the ">" and the attributes; values that nobody reads are left out."""
        html, pieces = self.html, []
        if at > self.last_end:
            return None
        while True:
            first = at
            at = _PLAIN.match(html, at).end()
            pieces.append(html[first:at])
            if at == len(html):
                return None
            if html[at] == ">":
                return at + 1, "".join(pieces)
            opening = _EQUALS.match(html, at).end()
            closing = self._closing(opening)
            if closing < 0:
                # a stray quote, as far as this tag goes
                pieces.append(html[at : opening + 1])
                at = opening + 1
            else:
                read = _READ.search(html, first, at)
                pieces.append(html[at : closing + 1] if read else '=""')
                at = closing + 1


def read_page(html: str) -> Page:
    """Parse ``html``; unclosed and crossed elements are closed as browsers do it."""
    page = Page()
    stack = [0]
    # places in the stack of the open elements of a tag, so that no search walks down a deep page
    open_at: dict[str, list[int]] = defaultdict(list)
    pieces: list[str] = []
    holder = 0

    def end_block() -> None:
        nonlocal holder
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                page.blocks.append((holder, text))
            pieces.clear()

    def text_piece(piece: str) -> None:
        nonlocal holder
        if piece:
            if not pieces:
                holder = stack[-1]
            pieces.append(piece)

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            open_at[page.tag[stack.pop()]].pop()

    def last_open(names) -> int:
        return max((open_at[name][-1] for name in names if open_at[name]), default=0)

    def innermost(names, barrier) -> int:
        found = last_open(names)
        return found if found and found >= last_open(barrier) else 0

    at, n = 0, len(html)
    quotes = _Quotes(html)
    while at < n:
        tag_start = html.find("<", at)
        if tag_start < 0:
            text_piece(html[at:])
            break
        match = _TAG.match(html, tag_start)
        is_tag = match is not None and match["name"] is not None
        ended = quotes.end_of_tag(match.end()) if is_tag else None
        if match is None or (is_tag and ended is None):
            text_piece(html[at : tag_start + 1])
            at = tag_start + 1
            continue
        text_piece(html[at:tag_start])
        if match["comment"]:
            end = html.find("-->", tag_start + 4)
            at = n if end < 0 else end + 3
            continue
        if match["decl"]:
            end = html.find(">", tag_start)
            at = n if end < 0 else end + 1
            continue
        at, attrs = ended
        tag = match["name"].lower()
        if match["close"]:
            if tag not in INLINE:
                end_block()
            # an inline end tag does not close the blocks around it
            depth = innermost((tag,), _SCOPE | {"p"} if tag in INLINE else frozenset())
            if depth:
                pop_to(depth)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
            at = n if end is None else end.end()
            continue
        if tag == "br" or (tag in VOID and tag in INLINE):
            text_piece(" ")
            continue
        if tag not in INLINE:
            end_block()
            depth = innermost(("p",), _SCOPE)
            if depth:
                pop_to(depth)
            if tag in _ENDS:
                depth = innermost(_ENDS[tag], _SCOPE - {"td", "th"})
                if depth:
                    pop_to(depth)
        if tag in VOID:
            continue
        above = stack[-1]
        names, role, hidden = set(), "", False
        if attrs and not attrs.isspace():
            for name, *values in _ATTR.findall(attrs):
                value = "".join(values).lower()
                name = name.lower()
                if name == "role":
                    role = value
                elif name == "hidden":
                    hidden = True
                else:
                    names.update(_SPLIT.split(value))
        names.discard("")
        in_main = page.in_main[above] or tag in ("article", "main") or role in ("main", "article")
        label = f"{tag}.{' '.join(sorted(names))}"
        page.children[above].append(_key(0, label))
        page.parent.append(above)
        page.tag.append(tag)
        page.key.append(_key(page.key[above], label))
        page.declared_noise.append(
            page.declared_noise[above] or hidden or _noise(tag, names, role, in_main)
        )
        page.in_main.append(in_main)
        page.children.append([])
        open_at[tag].append(len(stack))
        stack.append(len(page.tag) - 1)
    end_block()
    return page
