"""Leaf blocks of an HTML page: runs of text between block-level tags, with what stands around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span "
    "strike strong sub sup time tt u var wbr br "
    # MathML: a formula is part of the sentence that it stands in.
    "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover "
    "mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml".split()
)
# Elements whose content is never text of the page.
UNSEEN = frozenset(
    "script style noscript template iframe svg object audio video canvas select button textarea head title datalist map".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp".split())
# A start tag of the key ends an open element of the value.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "body": {"head"},
}
# Elements that an ENDS rule does not look beyond.
HOLDERS = frozenset("ul ol dl table body html div section article aside main nav header footer form".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"\b(class|id|role|href)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*([\w-]+)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    tag: str  # nearest block-level element
    tags: tuple[str, ...]  # all block-level elements around it, outermost first
    names: frozenset[str]  # words of their class, id and role
    linked: float  # share of characters in links


def hidden(attributes: str) -> bool:
    """Whether an element with these attributes is not shown: hidden, aria-hidden=true, or a style whose display is none."""
    seen = set()
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape("".join(values)).strip()
        if name in seen:
            continue  # the first of a name counts
        seen.add(name)
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style":
            display = _DISPLAY.findall(re.sub(r"/\*.*?\*/", "", value, flags=re.S))
            if display and display[-1].lower() == "none":
                return True
    return False


def leaf_blocks(page: str) -> list[Block]:
    """Blocks of a page in page order; broken nesting is mended as far as blocks need it."""
    blocks: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = []
    parts: list[str] = []
    linked: list[str] = []
    in_link, unseen, at = False, 0, 0

    def flush():
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not unseen:
                of_links = " ".join(html.unescape("".join(linked)).split())
                tags = tuple(t for t, _ in stack)
                names = frozenset().union(*(n for _, n in stack)) if stack else frozenset()
                blocks.append(Block(text, tags[-1] if tags else "", tags, names, min(1.0, len(of_links) / len(text))))
            parts, linked = [], []

    def said(text: str):
        if text and not unseen:
            parts.append(text)
            if in_link:
                linked.append(text)

    def pop_to(k: int):
        nonlocal unseen
        for tag, _ in stack[k:]:
            unseen -= tag in UNSEEN or tag == "~hidden"
        del stack[k:]

    n = len(page)
    while at < n:
        found = _TAG.search(page, at)
        if found is None:
            said(page[at:])
            break
        said(page[at : found.start()])
        at = found.end()
        closing, name, rest = found.group(1, 2, 3) if found.group(2) else found.group(4, 5, 6)
        if name is None:
            if found.group().startswith("<![CDATA["):
                said(html.escape(found.group()[9:].removesuffix("]]>")))
            continue
        name = name.lower()
        if name in INLINE:
            if name == "a":
                in_link = not closing and "href" in rest.lower()
            elif name in ("br", "mtd"):
                said(" ")
            continue
        flush()
        if closing:
            in_link = False
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name or stack[k][0] == "~hidden" and k and stack[k - 1][0] == name:
                    pop_to(k if stack[k][0] == name else k - 1)
                    break
                if name == "p" and stack[k][0] in HOLDERS:
                    break
            continue
        # An open paragraph ends where any block begins.
        while stack and stack[-1][0] == "p":
            pop_to(len(stack) - 1)
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ENDS.get(name, ()):
                pop_to(k)
            elif stack[k][0] in HOLDERS:
                break
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|</{re.escape(name)}\Z", re.I).search(page, at)
            at = end.end() if end else n
            continue
        words: set[str] = set()
        for attribute, *values in _NAMED.findall(rest):
            if attribute.lower() != "href":
                words.update(w.lower() for w in _PART.findall("".join(values)))
        stack.append((name, frozenset(words)))
        if name in UNSEEN:
            unseen += 1
        elif rest and hidden(rest):
            stack.append(("~hidden", frozenset()))
            unseen += 1
    flush()
    return blocks
