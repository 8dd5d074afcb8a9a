"""Leaf blocks of a page: runs of text between block-level tags, with what stands around them."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field

_QUOTED = r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
_COMMENT, _PLAIN = r"<!--.*?(?:-->|\Z)", r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>"
_TOKEN = re.compile(f"{_COMMENT}|{_QUOTED}|{_PLAIN}", re.S)
_TOKEN_WITHOUT_QUOTES = re.compile(f"{_COMMENT}|(?!)()()()|{_PLAIN}", re.S)
# Tags whose quotes never close that a page may have until its quotes are no longer looked at; each
# costs a search to the end of the page.
OPEN_QUOTES = 32
_OPEN_COMMENT = re.compile(r"<!--.*", re.S)
_ATTRIBUTE = re.compile(r"([\w:-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Their content is no markup, and no text of the page.
RAW = frozenset("script style template title iframe textarea".split())
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time "
    "tt u var wbr data ruby rb rt rp".split()
)
# Tags that are told apart as ancestors.
KNOWN = frozenset(
    "address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup html label legend li main math menu nav noscript object ol optgroup option p pre "
    "section select summary svg table tbody td tfoot th thead tr ul".split()
)
# An element that a new one of the same kind ends.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
# Words in class, id, role and itemprop by what they tell.
KEYWORDS = {
    word: group
    for group, words in {
        "nav": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc skip",
        "head": "header masthead topbar logo",
        "foot": "footer foot copyright colophon legal contentinfo",
        "side": "sidebar aside widget related recommended popular trending share social tags complementary",
        "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion adsense",
        "notice": "cookie cookies consent gdpr notice alert newsletter subscribe subscription popup modal overlay banner paywall",
        "form": "form login signup search",
        "comment": "comment comments reply replies respond discussion disqus",
        "body": "article content post entry story main body text prose",
    }.items()
    for word in words.split()
}
LABEL = "data-main"


@dataclass
class Block:
    """Text with white space made one, the share of it in links, and features of its ancestors."""

    text: str
    linked: float
    around: frozenset[str]
    tag: str
    labelled: bool


@dataclass
class _Open:
    tag: str
    around: frozenset[str] = frozenset()
    labelled: bool = False


@dataclass
class _Walk:
    stack: list[_Open] = field(default_factory=lambda: [_Open("")])
    opened: Counter[str] = field(default_factory=Counter)
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    found: list[Block] = field(default_factory=list)

    def text(self, raw: str) -> None:
        piece = html.unescape(raw) if "&" in raw else raw
        self.parts.append(piece)
        if self.links:
            self.linked += len(piece)

    def close(self) -> None:
        if self.parts:
            whole = "".join(self.parts)
            text = " ".join(whole.split())
            if text:
                top = self.stack[-1]
                self.found.append(Block(text, self.linked / len(whole), top.around, top.tag, top.labelled))
            self.parts, self.linked = [], 0

    def start(self, tag: str, attributes: str) -> None:
        self.close()
        if tag in SELF_ENDING and self.stack[-1].tag == tag:
            self.stack.pop()
            self.opened[tag] -= 1
        top = self.stack[-1]
        around, labelled = {f"in:{tag}"} if tag in KNOWN else set(), top.labelled
        if attributes and not attributes.isspace():
            values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
            told = " ".join(values.get(k, "") for k in ("class", "id", "role", "itemprop"))
            around |= {f"key:{KEYWORDS[w]}" for w in map(str.lower, _WORD.findall(told)) if w in KEYWORDS}
            style = values.get("style", "").replace(" ", "").lower()
            if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style:
                around.add("key:hidden")
            labelled = labelled or LABEL in values
        self.stack.append(_Open(tag, top.around | around if around - top.around else top.around, labelled))
        self.opened[tag] += 1

    def end(self, tag: str) -> None:
        self.close()
        while self.opened[tag]:
            closed = self.stack.pop().tag
            self.opened[closed] -= 1
            if closed == tag:
                break


def blocks(page: str | None) -> list[Block]:
    """Blocks in page order. Character references are decoded once; comments, scripts, styles and
    titles are no text; a tag that is never closed ends with its parent, and one of these that has no
    end tag ends where it begins, a script or style at the next tag. The work grows with the page's length, whatever it holds."""
    walk, at, page = _Walk(), 0, page or ""
    last, token, open_quotes = page.rfind(">"), _TOKEN, 0
    endless: set[str] = set()
    while True:
        # Behind the last > there are no tags, but a comment may begin.
        m = token.search(page, at) if at <= last else _OPEN_COMMENT.search(page, at)
        walk_to = m.start() if m else len(page)
        if walk_to > at:
            walk.text(page[at:walk_to])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower() if m.re is not _OPEN_COMMENT else ""
        if not tag:
            continue
        ends, attributes = m[1] or m[4], m[3] or m[6] or ""
        if m[5]:
            open_quotes += 1
            token = _TOKEN if open_quotes < OPEN_QUOTES else _TOKEN_WITHOUT_QUOTES
        if tag in RAW:
            if not ends and not attributes.endswith("/"):
                over = None if tag in endless else _RAW_END[tag].search(page, at)
                if over:
                    at = over.end()
                else:
                    endless.add(tag)
                    if tag in ("script", "style") and (at := page.find("<", at)) < 0:
                        break
            walk.close()
        elif tag in INLINE:
            if tag == "a":
                walk.links = max(0, walk.links + (-1 if ends else 1))
        elif tag == "br":
            walk.parts.append(" ")
        elif tag in VOID:
            walk.close()
        elif ends:
            walk.end(tag)
        elif attributes.endswith("/") and (walk.opened["svg"] or walk.opened["math"]):
            walk.close()
        else:
            walk.start(tag, attributes)
    walk.close()
    return walk.found
