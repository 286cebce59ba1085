"""HTML to leaf blocks: runs of text under one block-level element, with what stands around them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

# Kinds of HTML elements.
RAW = {"script", "style", "title", "textarea"}
#: Blocks of their own that don't end a paragraph.
EMBEDDED = {"noscript", "template", "iframe", "svg", "select", "button", "object", "canvas", "audio", "video", "noembed", "noframes"}
MATH = {"math", "mi", "mn", "mo", "ms", "mtext", "mrow", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mover", "munder", "munderover", "mtable", "mtr", "mtd", "mstyle", "mspace", "mpadded", "mphantom", "mfenced", "menclose", "merror", "mmultiscripts", "mprescripts", "none", "semantics", "annotation", "annotation-xml"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"} | MATH
#: Elements whose names are features of the text in them; others count as one.
KNOWN = EMBEDDED | {"html", "body", "head", "div", "p", "article", "section", "main", "header", "footer", "nav", "aside", "form", "fieldset", "figure", "figcaption", "blockquote", "pre", "address", "details", "summary", "dialog", "center", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "ul", "ol", "li", "menu", "dl", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th", "option", "optgroup", "legend", "search", "picture", "map"}
#: An opening element ends these open ones (up to an element in the second set).
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words in class, id and role, by what they hint at.
HINTS = {
    "ad": r"\bads?\b|advert|sponsor|promo|banner",
    "comment": r"comment|disqus|reply|replies|discussion",
    "menu": r"\bnav|menu|breadcrumb|tabs?\b|pagination|pager|toc\b",
    "foot": r"foot|copyright|legal|colophon",
    "head": r"masthead|\bheader|topbar|site-?title|logo",
    "side": r"side|widget|related|recommend|trending|popular|rail\b",
    "notice": r"notice|cookie|consent|alert|popup|modal|newsletter|subscribe|paywall|signup|login|overlay",
    "social": r"share|social|follow",
    "body": r"content|article|\bpost|entry|story|\bmain|body|text|prose",
    "hidden": r"hidden|display:\s*none|\bsr-only|screen-reader",
}
_HINTS = {k: re.compile(v) for k, v in HINTS.items()}
_TAG = re.compile(r"<(?:!--(?:.*?-->|.*\Z)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|/?[a-zA-Z][^>]*>|[!?/][^>]*>)", re.S)
_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"\b(?:class|id|role|style|hidden|aria-hidden|aria-label)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@dataclass
class Block:
    text: str
    tag: str
    around: frozenset[str]  # in:<element> and hint:<kind> of all ancestors
    links: float  # share of the text inside links


def _hints(attributes: str) -> set[str]:
    if not attributes.strip():
        return set()
    words = " ".join((m[1] or m[2] or m[3] or m[0]) for m in _ATTRIBUTE.finditer(attributes)).lower()
    return {f"hint:{k}" for k, v in _HINTS.items() if v.search(words)} if words else set()


def blocks(page: str) -> list[Block]:
    """All leaf blocks with text, in page order; never fails, however broken the page."""
    found: list[Block] = []
    stack: list[tuple[str, frozenset[str]]] = [("", frozenset())]
    # where each open tag stands in the stack, and where blocks stand: nothing below walks the stack
    open_at: dict[str, list[int]] = {}
    block_at: list[int] = [0]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            # white space becomes one space; character references are decoded first
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                found.append(Block(text, stack[block_at[-1]][0], stack[-1][1], min(1.0, linked / max(1, len(text)))))
            pieces.clear()
        linked = 0

    def last(tags: set[str]) -> int:
        return max((open_at[t][-1] for t in tags if open_at.get(t)), default=0)

    def pop_to(n: int) -> None:
        for tag, _ in stack[n:]:
            open_at[tag].pop()
        del stack[n:]
        while block_at[-1] >= n:
            block_at.pop()

    at, end = 0, page.rfind(">") + 1
    while at < end:
        m = _TAG.search(page, at, end)
        if m is None:
            break
        if m.start() > at:
            piece = page[at : m.start()]
            pieces.append(piece)
            if open_at.get("a"):
                linked += len(piece.strip())
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag not in INLINE:
                flush() if tag != "br" else pieces.append(" ")
            at_tag = last({tag})
            # an inline end tag doesn't reach beyond its block
            if at_tag and (tag not in INLINE or at_tag > block_at[-1]):
                pop_to(at_tag)
            continue
        if tag in VOID:
            if tag in ("br", "wbr", "img", "input"):
                pieces.append(" " if tag != "wbr" else "")
            elif tag == "hr":
                flush()
            continue
        if tag in RAW:
            # these have no self-closing form: a slash before the > says nothing
            close = _ENDS[tag].search(page, at)
            at = close.end() if close else len(page)
            continue
        if m[3].endswith("/") and (tag in MATH or tag == "svg" or "in:svg" in stack[-1][1]):
            continue
        if tag in EMBEDDED:
            flush()
        elif tag not in INLINE:
            flush()
            at_p = last({"p"})
            if at_p and at_p >= block_at[-1]:
                pop_to(at_p)
            if tag in CLOSES:
                ends, stops = CLOSES[tag]
                at_end = last(ends)
                if at_end > last(stops):
                    pop_to(at_end)
        around = stack[-1][1]
        more = _hints(m[3]) | ({f"in:{tag if tag in KNOWN else 'other'}"} if tag not in INLINE else set())
        stack.append((tag, around if more <= around else around | more))
        open_at.setdefault(tag, []).append(len(stack) - 1)
        if tag not in INLINE:
            block_at.append(len(stack) - 1)
    rest = page[at:] if at >= end else page[at:end] + page[end:]
    if at < len(page):
        # an element that is never closed is markup to the end
        cut = re.search(r"<[a-zA-Z!?/]", rest)
        pieces.append(rest[: cut.start()] if cut else rest)
    flush()
    return found
