"""A small HTML reader: blocks of text with the path of open elements, and links."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

#: Element names by what they do to the reader.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe xmp noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption"
    " figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p"
    " pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body html head option optgroup legend caption td th tr tbody thead tfoot".split())
#: An element that its like, or one of these, ends without an end tag; the search stops at the scopes.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPES = frozenset("html body article main section div td th table button form aside nav header footer".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


#: Long numbers in names differ from page to page where the branch is the same.
_DIGITS = re.compile(r"\d{3,}")


class Element(NamedTuple):
    tag: str
    attrs: dict[str, str]
    step: str


class Block(NamedTuple):
    path: tuple[Element, ...]
    text: str
    linked: int  # characters of source text inside links


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(source):
        out.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return out


def _element(tag: str, source: str) -> Element:
    attrs = attributes(source) if source and not source.isspace() else {}
    names = _DIGITS.sub("#", " ".join(sorted((attrs.get("class", "") + " " + attrs.get("id", "")).lower().replace("/", "-").split())))
    return Element(tag, attrs, f"{tag}.{names}" if names else tag)


def squeeze(text: str) -> str:
    """Character references decoded, white space turned into single blanks, ends trimmed."""
    return " ".join((html.unescape(text) if "&" in text else text).split())


def read(page: str | None) -> tuple[list[Block], str, list[tuple[str, str]]]:
    """(blocks in page order, title, links as (target, text)). Null and empty pages have none.

    Raw elements (scripts, styles) give no text; unclosed elements end where HTML ends them.
    """
    blocks: list[Block] = []
    links: list[tuple[str, str]] = []
    title = ""
    stack: list[Element] = []
    parts: list[str] = []
    anchor: list[str] | None = None
    target, linked = "", 0
    source, at = page or "", 0

    def flush() -> None:
        nonlocal linked
        if parts:
            if text := squeeze("".join(parts)):
                blocks.append(Block(tuple(stack), text, linked))
            parts.clear()
        linked = 0

    def end_to(k: int) -> None:
        if any(e.tag in BLOCK for e in stack[k:]):
            flush()
        del stack[k:]

    def end_anchor() -> None:
        nonlocal anchor
        if anchor is not None:
            links.append((target, squeeze("".join(anchor))))
            anchor = None

    while at < len(source):
        found = _TAG.search(source, at)
        piece = source[at : found.start() if found else len(source)]
        if piece:
            parts.append(piece)
            if anchor is not None:
                anchor.append(piece)
                linked += len(piece)
        if not found:
            break
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag:
            continue
        closing = bool(found[1] or found[4])
        if closing:
            if tag == "a":
                end_anchor()
            if tag == "br":
                parts.append(" ")
                continue
            if tag in ("p", "li") and not any(e.tag == tag for e in stack):
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    end_to(k)
                    break
                if tag not in BLOCK and stack[k].tag in BLOCK and stack[k].tag in _SCOPES:
                    break
            continue
        rest = (found[3] if found[2] else found[6]) or ""
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*/?>", re.I).search(source, at)
            if tag == "title" and not title and not any(e.tag == "svg" for e in stack):
                title = squeeze(source[at : end.start() if end else len(source)])
            at = end.end() if end else len(source)
            continue
        if tag in CLOSES_P:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    end_to(k)
                    break
                if stack[k].tag in _SCOPES:
                    break
        if tag in SIBLINGS:
            like, scopes = SIBLINGS[tag]
            cut = None
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in scopes:
                    break
                if stack[k].tag in like:
                    cut = k
            if cut is not None:
                end_to(cut)
        if tag in VOID:
            if tag == "hr":
                flush()
            parts.append(" " if tag == "br" else "")
            continue
        if tag in BLOCK:
            flush()
        if tag == "body" or tag == "html":
            if any(e.tag == tag for e in stack):
                continue
        element = _element(tag, rest)
        if rest.rstrip().endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span", "em", "strong"):
            continue
        stack.append(element)
        if tag == "a":
            end_anchor()
            anchor, target = [], element.attrs.get("href", "")
    flush()
    end_anchor()
    return blocks, title, links
