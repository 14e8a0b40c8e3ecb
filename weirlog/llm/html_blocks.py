"""HTML to leaf blocks: text between block-level tags, with the path of tags that leads to it."""

from __future__ import annotations

import html
import re

#: Fixed names of the markup: elements that don't break a line, have no end, or hold no text to read.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var wbr br nobr object canvas audio video svg g text tspan textpath path rect circle "
    "ellipse line polyline polygon use defs symbol math maction menclose merror mfrac mi mmultiscripts mn mo mover "
    "mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder "
    "munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style template textarea title iframe".split())
#: Of these the content is text only, which runs to the end of the page where the end tag is missing.
RAW = frozenset("script style textarea title iframe".split())
#: Elements that can't be inside an open one of the other skipped ones unless that has an end tag.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td "
    "tfoot th thead tr ul".split()
)
#: A start tag of the first closes an open element of the second, up to one of the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S
)
_MARKS = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_PAIRS = {
    name: re.compile(
        rf"<!--.*?(?:-->|\Z)|<({'|'.join(sorted(RAW))})(?=[\s/>])(?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
        rf"|<(/?){name}(?=[\s/>])((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>",
        re.S | re.I,
    )
    for name in SKIPPED - RAW
}
_WORD = re.compile(r"[a-z]+")
_marks_of: dict[str, tuple[str, ...]] = {}


def _names(tag: str, attributes: str) -> tuple[str, ...]:
    """A tag's name and the words of its class, id and role."""
    key = tag + attributes
    known = _marks_of.get(key)
    if known is None:
        found = [tag]
        if "=" in attributes:
            for m in _MARKS.finditer(attributes):
                value = m[2] or m[3] or m[4] or ""
                value = re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower()
                found += [f".{w}" for w in _WORD.findall(value)]
        known = tuple(dict.fromkeys(found))
        if len(_marks_of) > 50_000:
            _marks_of.clear()
        _marks_of[key] = known
    return known


def _ends_of(page: str, tag: str) -> dict[int, int]:
    """Where each element of a name that has an end tag starts, and the end of that tag."""
    out, opened = {}, []
    # behind the last > there is no tag, and each < there would be followed to the end of the page
    for m in _PAIRS[tag].finditer(page, 0, page.rfind(">") + 1):
        if m[2]:
            if opened:
                out[opened.pop()] = m.end()
        elif m[2] is not None and not m[3].endswith("/"):
            opened.append(m.start())
    return out


def blocks(page: str | None) -> list[tuple[tuple[tuple[str, ...], ...], str, int]]:
    """(path, text, characters inside links) of each block with text, in page order.

    The path holds the block-level elements around the text, outermost first, each with its marks.
    Character references are decoded, white space is one blank. Ends that were left out are closed as
    browsers do for paragraphs, list items and table cells. Formulas, drawings and what stands in for media are read in their
    line like other text. A skipped element without an end tag ends at
    the next tag of a block, or with the page if it holds text only, such as a script.
    """
    out: list = []
    if not page:
        return out
    stack: list[str] = []
    path: list[tuple[str, ...]] = []
    text: list[str] = []
    link = linked = 0
    at = 0
    ends: dict[str, dict[int, int]] = {}
    mute = ""

    def flush():
        nonlocal linked
        if text:
            joined = "".join(text)
            if "&" in joined:
                joined = html.unescape(joined)
            joined = " ".join(joined.split())
            if joined:
                out.append((tuple(path), joined, linked))
            text.clear()
        linked = 0

    size = len(page)
    # behind the last > there is no tag, only text and perhaps a comment without an end
    tail = page.rfind(">") + 1
    search = _TOKEN.search
    while at < size:
        m = search(page, at, tail) if at < tail else None
        if m is None:
            if not mute:
                comment = page.find("<!--", at)
                text.append(page[at:] if comment < 0 else page[at:comment])
            break
        if m.start() > at and not mute:
            piece = page[at : m.start()]
            text.append(piece)
            if link:
                linked += len(piece)
        at = m.end()
        tag = m[2]
        if tag is None:
            if at == tail and m[0].startswith("<!--") and not (len(m[0]) > 6 and m[0].endswith("-->")):
                break
            continue
        tag = tag.lower()
        if mute:
            if tag in BLOCK and (not m[1] or tag in stack):
                mute = ""
            elif m[1] or tag not in SKIPPED:
                if m[1] and tag == mute:
                    mute = ""
                continue
        if m[1]:
            if tag == "a":
                link = max(0, link - 1)
            elif tag not in INLINE:
                flush()
                if tag in stack:
                    k = len(stack) - 1 - stack[::-1].index(tag)
                    del stack[k:], path[k:]
                link = 0
            continue
        if tag in SKIPPED:
            if not m[3].endswith("/"):
                if tag in RAW:
                    end = _ENDS[tag].search(page, at)
                    at = end.end() if end else size
                    continue
                if tag not in ends:
                    ends[tag] = _ends_of(page, tag)
                end = ends[tag].get(m.start())
                if end:
                    at = end
                else:
                    mute = mute or tag
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag == "a":
            link += 1
            continue
        if tag in INLINE:
            continue
        flush()
        link = 0
        if tag in VOID:
            continue
        if stack:
            if stack[-1] == "p":
                stack.pop()
                path.pop()
            closing = CLOSES.get(tag)
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] in closing[1]:
                        break
                    if stack[k] in closing[0]:
                        del stack[k:], path[k:]
                        break
        if not m[3].endswith("/"):
            stack.append(tag)
            path.append(_names(tag, m[3]))
    flush()
    return out
