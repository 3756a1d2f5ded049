"""Text blocks of raw web pages, each with the path of its tags.

A block is the text between two borders of block elements; markup within a line
doesn't end it. Paths are interned: a state is an element with its parents, and
blocks of one container share it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup svg time tt u var".split()
)
KEEPS_P = INLINE | VOID - {"hr"} | {"option", "optgroup", "select", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "li", "dt", "dd"}
CLOSES = {  # a start tag ends an open element of the first names, if none of the second stands between
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
P_ENDS_AT = frozenset("table td th caption button object".split())
TOKEN = re.compile(r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)(?:>|\Z)""", re.S)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
NAMES = re.compile(r"""(?:^|[\s"'])(class|id|role|style|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
BUCKETS = 1024
DEPTH = 512  # elements below stay in their parent, as in browsers


def name_tokens(attributes: str) -> list[str]:
    """Words of class, id and role, and whether the element is hidden."""
    out = []
    for kind, value in NAMES.findall(attributes):
        kind = kind.lower()
        if kind == "hidden" or kind == "style":
            if kind == "hidden" or re.search(r"display\s*:\s*none", value, re.I):
                out.append("hidden")
        else:
            out += [w.lower() for w in NAME.findall(value)]
    return out


class Paths:
    """Interned paths. features[state]: hashed places of an element's own names and of its parents' names; state 0 is the page."""

    def __init__(self):
        self.known: dict[tuple[int, str, str], int] = {}
        self.features: list[tuple[int, ...]] = [()]
        self.above: list[frozenset[str]] = [frozenset()]

    def child(self, parent: int, tag: str, attributes: str) -> int:
        key = (parent, tag, attributes)
        state = self.known.get(key)
        if state is None:
            own = [tag, *(f".{n}" for n in name_tokens(attributes))]
            above = self.above[parent]
            places = {crc32(f"own {n}".encode()) % BUCKETS for n in own} | {crc32(f"in {n}".encode()) % BUCKETS for n in [*own, *above]}
            state = self.known[key] = len(self.features)
            self.features.append(tuple(sorted(places)))
            self.above.append(above | frozenset(own))
        return state


def page_blocks(html: str, paths: Paths) -> Iterator[tuple[int, str, int]]:
    """(state, text, characters in links) of each block with text, in page order. Any string is a page: unknown and unclosed tags, and ends without a start, only move borders."""
    stack: list[tuple[str, bool, int, bool]] = [("", True, 0, False)]  # name, block, state, within a link
    parts: list[str] = []
    linked = 0

    def flush(state: int):
        nonlocal linked
        text, links = " ".join("".join(parts).split()), linked
        parts.clear()
        linked = 0
        if text:
            yield state, text, min(links, len(text))

    def pop_to(names, stops) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in stops:
                return

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        stop = m.start() if m else end
        if stop > at:
            text = html[at:stop]
            text = unescape(text) if "&" in text else text
            parts.append(text)
            if stack[-1][3]:
                linked += len(" ".join(text.split()))
        if not m:
            break
        at = m.end()
        if m.group(2) is None:
            continue
        tag = m.group(2).lower()
        if not m.group(1):
            if tag in RAW:
                close = RAW_END[tag].search(html, at)
                at = close.end() if close else end
            elif tag in INLINE:
                if len(stack) < DEPTH:
                    stack.append((tag, False, stack[-1][2], stack[-1][3] or tag == "a"))
            elif tag in VOID:
                if tag == "hr":
                    yield from flush(stack[-1][2])
                else:
                    parts.append(" " if tag == "br" else "")
            else:
                yield from flush(stack[-1][2])
                if tag not in KEEPS_P:
                    pop_to({"p"}, P_ENDS_AT)
                if tag in CLOSES:
                    pop_to(*CLOSES[tag])
                if len(stack) < DEPTH:
                    stack.append((tag, True, paths.child(stack[-1][2], tag, m.group(3).strip()), stack[-1][3]))
        elif tag in INLINE:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
                if stack[i][1]:
                    break
        elif tag not in VOID:
            yield from flush(stack[-1][2])
            pop_to({tag}, P_ENDS_AT if tag == "p" else ())
    yield from flush(stack[-1][2])
