"""Blocks of a page with their part in it, read from its tags."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from tallyspark.sources.references import decoded

#: What a block is: inside the article, inside the main element, of no known part, or furniture.
ARTICLE, MAIN, OTHER, FURNITURE = 0, 1, 2, 3

#: Elements whose content is no text.
_RAW = frozenset("script style noscript template iframe svg textarea title object canvas select".split())
#: A tag whose quotes are closed: they count only after an equals sign. No part of it is tried twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=(?:\s*+(?:"[^"]*+"|'[^']*+'))?+)*+)>""")
_NAME = re.compile(r"[^\s/]*+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in _RAW}
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?+""")
_WORD = re.compile(r"[a-z]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
_CONTAINERS = frozenset("article aside blockquote body dd details dialog div dl fieldset figure footer form header html li main menu nav ol section table tbody td th tr ul".split())
#: Elements, roles and words of class or id that mark furniture.
_TAGS = frozenset("nav footer aside form button dialog menu head".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
_LABELS = frozenset(
    "ad ads adsense adslot advert advertisement advertising adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus"
    " footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion"
    " recommended related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Labels that are also given to wrappers of a whole page, and labels whose holders may stand around it.
_LOOSE_LABELS = frozenset("banner consent cookie cookies gdpr header login masthead modal newsletter notice notices overlay popup signup subscribe subscription toolbar widget".split())
_LAYOUT_LABELS = frozenset("aside login menu modal notice notices overlay sidebar subscription toolbar widget".split())
#: Words that may stand beside labels in a class or id that names furniture (site-footer, ad-slot), and words that may beside labels of no layout (comments-wrapper, not sidebar-wrapper).
_BESIDE = frozenset(
    "area article articles bar block body bottom box button buttons card cards column columns desktop entry fixed follow form global google heading icon icons image info inline inner"
    " item items label leaderboard left link links list main media message mobile more placeholder policy post posts primary right row secondary section site slot small sticky stories"
    " story text this title top unit us widgets".split()
)
_HOLDERS = frozenset("container content holder outer wrap wrapper".split())
#: Levels of furniture: a form, which may stand around the page; a label that may; none that does.
#: An article or main element ends the first two.
FORM, LOOSE, SHUT = 1, 2, 3


def _label(token: str, in_article: bool) -> int:
    """Level of a class or id: that of its labels, if it holds but labels and words beside them."""
    words = set(_WORD.findall(token))
    labels = words & _LABELS or (set() if in_article else words & {"header"})
    rest = words - labels - _BESIDE - {"header"}
    if not labels or rest and (not rest <= _HOLDERS or not in_article and labels & _LAYOUT_LABELS):
        return 0
    return LOOSE if labels <= _LOOSE_LABELS else SHUT


def _furniture(name: str, attrs: str, in_article: bool) -> int:
    """Level of furniture that an element is by itself, or 0."""
    level = 0
    if name in _TAGS:
        level = FORM if name == "form" else SHUT
    elif name == "header" and not in_article:
        level = LOOSE
    if not attrs or name in ("html", "body", "main") or name == "article" and not in_article:
        return level
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "class" or key == "id":
            level = max([level, *(_label(t, in_article) for t in value.split())])
        elif key == "role" and value in _ROLES:
            level = max(level, FORM if value == "form" else SHUT)
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            level = SHUT
    return level


def tags_of(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closes, name, attributes) of each tag, in one pass; comments, declarations
    and elements whose content is no text come with an empty name.

    A tag that never ends by its quotes makes quotes count no more from there on, and where no
    ``>`` is left, all is text: so no stretch of a page is read more than a few times.
    """
    at, quotes = html.find("<"), True
    while at >= 0:
        end = at + 1
        ahead = html[end : end + 3]
        if ahead == "!--":
            end = html.find("-->", at + 4)
            end = len(html) if end < 0 else end + 3
            yield at, end, False, "", ""
        elif ahead[:1] in ("!", "?"):
            end = html.find(">", at) + 1
            if not end:
                return
            yield at, end, False, "", ""
        elif ahead[:1].isascii() and ahead[:1].isalpha() or ahead[:1] == "/" and ahead[1:2].isascii() and ahead[1:2].isalpha():
            m = _TAG.match(html, at) if quotes else None
            if m:
                slash, name, attrs = m.groups()
                end = m.end()
            else:
                quotes, end = False, html.find(">", at) + 1
                if not end:
                    return
                rest = html[at + 1 : end - 1]
                slash = rest[:1] if rest[0] == "/" else ""
                name = _NAME.match(rest, len(slash)).group()
                attrs = rest[len(slash) + len(name) :]
            name = name.lower()
            if name in _RAW and not slash:
                close = _RAW_END[name].search(html, end)
                end = html.find(">", close.end()) + 1 if close else 0
                end = end or len(html)
                name = ""
            yield at, end, bool(slash), name, attrs
        at = html.find("<", end)


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    """(part, text) of each block with text, in page order; references decoded, spaces single.

    Forms that hold more words than all text outside furniture stand around the page: their
    blocks have the part that they would have without the form.
    """
    html = html or ""
    out: list[tuple[int, str, int]] = []  # part, text, part without the form
    stack: list[tuple[str, int, bool, int, int]] = []  # element, part, in an article, level, part without the form
    page = (OTHER, False, 0, OTHER)
    part, in_article, level, bare = page
    text, at = [], 0
    held: Counter[str] = Counter()  # how often an element is on the stack

    def end_block():
        if text:
            plain = " ".join(decoded("".join(text)).split())
            if plain:
                out.append((part, plain, bare if level == FORM else part))
            text.clear()

    for start, end, closes, name, attrs in tags_of(html):
        if start > at:
            text.append(html[at:start])
        at = end
        if not name:
            continue
        if name in _INLINE and not (attrs and not closes and _furniture(name, attrs, in_article)):
            if not (closes and held[name]):
                continue
        else:
            end_block()
        if closes:
            if held[name]:
                end_block()
                while True:
                    last = stack.pop()[0]
                    held[last] -= 1
                    if last == name:
                        break
                part, in_article, level, bare = stack[-1][1:] if stack else page
            continue
        if name in _VOID or attrs.endswith("/") and name not in _CONTAINERS:
            continue
        if stack and stack[-1][0] in ("p", "li") and (name == stack[-1][0] or stack[-1][0] == "p" and name not in _INLINE):
            held[stack.pop()[0]] -= 1  # these end where the next one starts
            part, in_article, level, bare = stack[-1][1:] if stack else page
        own = _furniture(name, attrs, in_article)
        if name == "article" and in_article:
            own = SHUT
        before = part, level
        if level < SHUT and not own and name in ("article", "main"):
            level = 0
            part = bare = ARTICLE if name == "article" or in_article else MAIN
            in_article = part == ARTICLE
        elif own:
            part, level = FURNITURE, max(level, own)
        if (part, level) != before or name in _CONTAINERS:
            stack.append((name, part, in_article, level, bare))
            held[name] += 1
    text.append(html[at:])
    end_block()
    in_forms = sum(len(t.split()) for p, t, b in out if p != b)
    around = in_forms > sum(len(t.split()) for p, t, _ in out if p != FURNITURE)
    return [(b if around else p, t) for p, t, b in out]
