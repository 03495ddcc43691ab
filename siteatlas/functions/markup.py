"""Elements of a markup text with the regions they cover, by one pass with a stack."""

from __future__ import annotations

import html
import re

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|noscript)\b(?P<raw_attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements without content, and elements that end an open paragraph.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
ENDS_PARAGRAPH = [
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
]

#: An opening tag ends the open elements on the left of it, unless one of those on the right stands in between.
ENDED_BY = {tag: (["p"], ["table", "td", "th", "button"]) for tag in ENDS_PARAGRAPH} | {
    "li": (["p", "li"], ["ul", "ol"]),
    "dt": (["p", "dt", "dd"], ["dl"]),
    "dd": (["p", "dt", "dd"], ["dl"]),
    "option": (["option"], ["select"]),
    "tr": (["tr", "td", "th"], ["table"]),
    "td": (["td", "th"], ["tr", "table"]),
    "th": (["td", "th"], ["tr", "table"]),
    "tbody": (["tr", "td", "th", "tbody", "thead"], ["table"]),
}


def attributes(text: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of each name; one without a value is empty."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), html.unescape(next((v for v in values if v), "")))
    return found


def elements(text: str) -> list[tuple[int, int, int, str, dict[str, str]]]:
    """(last, level, parent, tag, attributes) of each element in document order; its own number is its place.

    ``last`` is the number of the last element inside, or its own; ``parent`` is
    -1 at the top.  An end tag closes the nearest open element of its name and
    what is open inside; one without an open element does nothing.  What is open
    at the end ends there.  The content of scripts, styles, titles and text
    areas is text.
    """
    rows: list[list] = []
    stack: list[int] = []

    def close(down_to: int) -> None:
        for n in stack[down_to:]:
            rows[n][0] = len(rows) - 1
        del stack[down_to:]

    for m in TOKEN.finditer(text):
        tag = (m["raw"] or m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            at = next((k for k in range(len(stack) - 1, -1, -1) if rows[stack[k]][3] == tag), None)
            if at is not None:
                close(at)
            continue
        ended, stops = ENDED_BY.get(tag, ((), ()))
        if ended:
            first = None
            for k in range(len(stack) - 1, -1, -1):
                name = rows[stack[k]][3]
                if name in stops:
                    break
                if name in ended:
                    first = k
            if first is not None:
                close(first)
        n = len(rows)
        given = m["raw_attrs"] if m["raw"] else m["attrs"]
        rows.append([n, len(stack), stack[-1] if stack else -1, tag, attributes(given.rstrip("/"))])
        if not m["raw"] and tag not in VOID:
            stack.append(n)
    close(0)
    return [tuple(r) for r in rows]
