"""Blocks of text of a raw web page, with where they stand in its tree and what the page says of their part.

A page is read once from left to right, in time linear in its length: tags that aren't closed, wrong ends, quotes that
never end and text cut off in a tag give blocks all the same.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?+")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

#: Elements whose text isn't text of the page, up to their own end tag or (RAW) whatever stands in them.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
UNSEEN = frozenset("head template noscript svg math object canvas audio video select datalist button".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var meter progress picture".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of a key ends an open one of its values.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
_SCOPES = frozenset("ul ol dl table body html".split())

#: What an element says of the text in it: an article, a place where articles are, something else, or nothing.
ARTICLE, PLACE, NOTHING, OTHER = "article", "place", "", "other"
_OTHER_TAGS = frozenset("nav aside footer menu dialog fieldset".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist tooltip status".split())
_OTHER_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer foot masthead topbar toolbar ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending popular "
    "pagination pager widget copyright legal disclaimer search form skip toc".split()
)
_COMMENT_WORDS = frozenset("comment comments commentlist discussion disqus respond replies reply responses".split())
_PLACE_WORDS = frozenset("article post entry story content main body text".split())


@dataclass
class Block:
    """A run of text between two borders of blocks: white space made one, linked characters of all, the nearest block element and its parents by number, and the part that the page gives it."""

    text: str
    tag: str
    element: int
    parent: int
    linked: int
    part: str


def _part(tag: str, raw: str) -> tuple[str, bool]:
    """The part that an element declares, and whether that holds even if an article lies in it."""
    if tag in ("form", "header"):
        part, sure = OTHER, False
    elif tag in _OTHER_TAGS:
        part, sure = OTHER, True
    else:
        part, sure = (ARTICLE if tag == "article" else PLACE if tag == "main" else NOTHING), False
    if not raw or raw.isspace():
        return part, sure
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}
    role = found.get("role", "").lower()
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.IGNORECASE):
        return OTHER, True
    if tag in ("html", "body"):
        return part, sure
    words = {w.lower() for k in ("class", "id") for w in _WORDS.findall(found.get(k, ""))}
    if words & _COMMENT_WORDS:
        return OTHER, True
    if part == OTHER:
        return part, sure
    if role in _OTHER_ROLES:
        return OTHER, True
    if role in ("main", "article") or found.get("itemprop") == "articleBody":
        return (PLACE if role == "main" else ARTICLE), False
    if words & _OTHER_WORDS:
        return OTHER, False
    if part == NOTHING and ("header" in words or "head" in words) and not words & _PLACE_WORDS:
        return OTHER, False
    return (PLACE if part == NOTHING and words & _PLACE_WORDS else part), sure


def blocks(html: str | None) -> list[Block]:
    """The blocks of a page in order; none for a null or empty page, or one without text."""
    if not html:
        return []
    tags, parents, parts, sure = ["#page"], [-1], [NOTHING], [False]
    nearest = [0]  # block element of each element: itself, or the one around it
    stack: list[int] = [0]
    where: dict[str, list[int]] = {}  # depths of the open elements of a name
    scopes: list[int] = []
    unseen = 0
    out: list[tuple[str, int, int]] = []
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append((text, nearest[stack[-1]], linked))
            pieces.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal unseen
        while len(stack) > depth:
            tag = tags[stack[-1]]
            if tag not in INLINE:
                flush()
            stack.pop()
            where[tag].pop()
            if tag in _SCOPES:
                scopes.pop()
            unseen -= tag in UNSEEN

    def ended(names: frozenset[str] | set[str]) -> None:
        """Closes what the names say, up to the nearest scope."""
        depth = min((x for n in names if where.get(n) for x in where[n][-1:] if not scopes or x > scopes[-1]), default=0)
        if depth:
            close(depth)

    at, end, pattern = 0, len(html), _TAG
    while at < end:
        start = html.find("<", at)
        if start < 0:
            start = end
        if start > at and not unseen:
            piece = unescape(html[at:start])
            pieces.append(piece)
            if where.get("a"):
                linked += len("".join(piece.split()))
        if start == end:
            break
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            at = end if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), start):
            stop = html.find(">", start)
            at = end if stop < 0 else stop + 1
            continue
        m = pattern.match(html, start)
        if m is None and html[start + 1 : start + 2].isalpha() | html.startswith("</", start):
            if html.find(">", start) < 0:
                break  # cut off in a tag
            pattern = _LOOSE  # a quote never ends: from here on, tags end at their first >
            m = pattern.match(html, start)
            if m is None:  # an end tag without a name
                at = html.find(">", start) + 1
                continue
        if m is None:
            if not unseen:
                pieces.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if where.get(tag):
                close(where[tag][-1])
            elif tag not in INLINE:
                flush()
            continue
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
            at = end if stop is None else stop.start()
            if stop is not None:
                at = html.find(">", at) + 1 or end
            if tag == "textarea" or tag == "iframe":
                pieces.append(" ")
            continue
        if tag in EMPTY:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        if tag not in INLINE:
            flush()
            ended({"p"})
            if tag in _ENDS:
                ended(_ENDS[tag])
        elif tag == "a" and where.get("a"):
            close(where["a"][-1])
        if m[3].endswith("/") and tag not in INLINE and tag in ("svg", "math"):
            continue
        part, certain = _part(tag, m[3]) if tag not in INLINE or m[3] else (NOTHING, False)
        tags.append(tag)
        parents.append(stack[-1])
        parts.append(part)
        sure.append(certain)
        nearest.append(nearest[stack[-1]] if tag in INLINE else len(tags) - 1)
        where.setdefault(tag, []).append(len(stack))
        if tag in _SCOPES:
            scopes.append(len(stack))
        stack.append(len(tags) - 1)
        unseen += tag in UNSEEN
    flush()
    # what holds an article isn't something else for its class alone
    n = len(tags)
    holds = [False] * n
    for e in range(n - 1, 0, -1):
        if holds[e] or (tags[e] in ("article", "main") and parts[e] != OTHER):
            holds[parents[e]] = True
    role = [NOTHING] * n
    article = [False] * n
    for e in range(1, n):
        up = parents[e]
        part = parts[e]
        if part == OTHER and not sure[e] and (holds[e] or (article[up] and tags[e] == "header")):
            part = NOTHING
        article[e] = article[up] or part == ARTICLE
        role[e] = OTHER if OTHER in (role[up], part) else ARTICLE if article[e] else part or role[up]
    return [Block(text, tags[e], e, nearest[max(0, parents[e])], linked, role[e]) for text, e, linked in out]
