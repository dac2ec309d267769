"""A page as a sequence of tags and texts, each with its place in the element tree.

Pages are read as browsers would: missing end tags are supplied, scripts and styles are raw
text, stray end tags are passed over. An element left open holds what follows it, but one
that is no part of the article (a menu that nobody closed) ends where an article begins.
"""

from __future__ import annotations

import re
from typing import NamedTuple

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_RAW = {n: re.compile(rf"</{n}\b[^>]*>", re.I) for n in ("script", "style", "textarea", "title", "iframe", "xmp", "noframes")}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr img".split())
#: Elements inside a container: they make blocks of text, but no place of their own.
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th tbody thead tfoot ul ol dl table blockquote pre figure figcaption caption "
                   "option hr br".split())
#: Elements that are no part of an article.
OUTSIDE = frozenset("head nav header footer aside form script style noscript template button select textarea iframe svg dialog "
                    "menu title object applet canvas audio video map xmp noframes".split())
#: Words of class, id or role that say the same.
OUTSIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
                          "consent gdpr notice notices notification sidebar aside menu menus nav navbar navigation breadcrumb "
                          "breadcrumbs header masthead footer topbar toolbar comment comments disqus respond replies share sharing "
                          "social related recommended newsletter subscribe subscription signup login popup modal overlay widget "
                          "pagination pager complementary contentinfo search".split())
_HEADING_WORDS = frozenset({"header"})
_ARTICLE_WORDS = frozenset("article post entry story content".split())
#: A new one of these ends an open one of the same kind, up to the given elements.
_ENDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"},
         "option": {"select"}}


class Piece(NamedTuple):
    """A start tag (``text`` is None) or a text. ``path``: its containers; ``shown``: not
    outside the article; ``article``: inside an article or main element; ``block``: number of
    its block of text."""

    key: str
    text: str | None
    path: str
    shown: bool
    article: str
    block: int


class _Frame(NamedTuple):
    name: str
    path: str
    out_closed: bool  # inside an outside element that has an end tag
    out: bool
    article: str


def _events(page: str) -> list[tuple[int, str, str]]:
    """(kind, name or text, attributes): 0 text, 1 start tag, 2 end tag."""
    out, at = [], 0
    for_raw = _RAW
    while (m := _MARKUP.search(page, at)) is not None:
        if m.start() > at:
            out.append((0, page[at:m.start()], ""))
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:
            out.append((2, name, ""))
            continue
        out.append((1, name, m[3] or m[6] or ""))
        if name in for_raw:
            end = for_raw[name].search(page, at)
            stop, after = (end.start(), end.end()) if end else (len(page), len(page))
            if stop > at:
                out.append((0, page[at:stop], ""))
            out.append((2, name, ""))
            at = after
    if at < len(page):
        out.append((0, page[at:], ""))
    return out


def _is_outside(name: str, words: set[str]) -> bool:
    if name in OUTSIDE:
        return True
    if name in ("html", "body", "main"):
        return False
    hints = words & OUTSIDE_WORDS
    if hints and words & _ARTICLE_WORDS:
        hints -= _HEADING_WORDS
    return bool(hints & {"comment", "comments"}) if name == "article" else bool(hints)


def _drop_to(stack: list, name: str, stops: frozenset | set | None) -> int:
    """Where on the stack the nearest open ``name`` is, above any of ``stops``; -1 if nowhere."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i] == name:
            return i
        if stops is not None and stack[i] in stops:
            return -1
    return -1


def _implied(names: list[str], name: str) -> int:
    """How many open elements stay when ``name`` begins."""
    if name in _ENDS:
        i = _drop_to(names, name, _ENDS[name])
        return i if i >= 0 else len(names)
    if name not in INLINE and name not in VOID:
        for i in range(len(names) - 1, -1, -1):  # a block ends an open paragraph
            if names[i] == "p":
                return i
            if names[i] not in INLINE:
                break
    return len(names)


def _closed(events: list[tuple[int, str, str]]) -> list[bool]:
    """Of each event: whether it is a start tag that has its own end tag."""
    closed = [False] * len(events)
    names: list[str] = []
    begun: list[int] = []
    for k, (kind, name, _) in enumerate(events):
        if kind == 1:
            stay = _implied(names, name)
            del names[stay:], begun[stay:]
            if name not in VOID:
                names.append(name)
                begun.append(k)
        elif kind == 2:
            i = _drop_to(names, name, None)
            if i >= 0:
                closed[begun[i]] = True
                del names[i:], begun[i:]
    return closed


def parse(page: str) -> list[Piece]:
    events = _events(page)
    closed = _closed(events)
    names: list[str] = []
    frames = [_Frame("", "", False, False, "")]  # frames[i + 1] belongs to names[i]
    out: list[Piece] = []
    block = 0
    for k, (kind, name, more) in enumerate(events):
        top = frames[-1]
        if kind == 0:
            if not name.isspace():
                out.append(Piece("", name, top.path, not top.out, top.article, block))
            elif out and out[-1].text is not None and out[-1].block == block:
                out.append(Piece("", " ", top.path, not top.out, top.article, block))
            continue
        if name not in INLINE and name != "br":
            block += 1
        if kind == 2:
            i = _drop_to(names, name, None)
            if i >= 0:
                del names[i:], frames[i + 1:]
            continue
        stay = _implied(names, name)
        del names[stay:], frames[stay + 1:]
        top = frames[-1]
        if name == "br":
            out.append(Piece("", " ", top.path, not top.out, top.article, block))
            continue
        shown_names, words = "", set()
        if more:
            found = ["".join(m.groups(default="")[1:]) for m in _NAMES.finditer(more)]
            words = {w.lower() for f in found for w in _WORD.findall(f)}
            shown_names = re.sub(r"\d+", "0", ".".join(found))
        label = f"{name}.{shown_names}" if shown_names else name
        out.append(Piece(f"{top.path}<{label}", None, top.path, not top.out, top.article, block))
        if name in VOID:
            continue
        main = name in ("article", "main") or "main" in words and name not in INLINE and name not in LEAVES
        outside = _is_outside(name, words)
        if name == "header" and top.article:  # an article's own heading
            outside = False
        out_before = top.out_closed if main else top.out
        article = "article" if name == "article" or top.article == "article" else "main" if main else top.article
        path = top.path if name in INLINE or name in LEAVES else f"{top.path}/{label}"
        names.append(name)
        frames.append(_Frame(name, path, top.out_closed or outside and closed[k], out_before or outside, article))
    return out
