"""A page as a sequence of tokens: tags by the path of elements that they lie in, and runs of text.

Markup need not be well formed. Void elements have no end; paragraphs, list items, cells and the like end where the next one starts; an
end tag ends what was left open inside its element and is passed over where nothing is open; at the end of the page all elements end.
Scripts, styles, text areas and titles are raw text. Comments, declarations and tags that the page breaks off are passed over.
"""

from __future__ import annotations

import html as entities
import re

import xxhash

START, END, TEXT = range(3)
#: How a run of text is marked off as not of the article: not at all, by a wrapper that an article or main inside lifts, for good.
NONE, SOFT, HARD = range(3)

# Element names of HTML and words that pages use in class, id and role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rp rt s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
IN_HEAD = frozenset("title meta link script style base noscript template".split())
NEVER = frozenset(
    "head script style noscript template svg math canvas audio video object iframe nav footer aside button select textarea dialog menu"
    " noembed xmp datalist".split()
)
PARTS = frozenset(("article", "main"))
WORDS = frozenset(
    "ad ads adsense advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar aside nav navbar navigation menu"
    " breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup social share"
    " sharing related recommended comment comments commentlist respond discussion disqus replies reply pagination pager toolbar widget widgets"
    " login search copyright disclaimer contentinfo complementary dialog alert".split()
)
PAGE_HEADER = frozenset("header masthead topbar".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An element whose start ends open ones of the first set, unless one of the second lies between.
ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
_PARAGRAPH = (frozenset(["p"]), frozenset("article aside blockquote body button div fieldset form li main nav section table td th".split()))

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<end2>/?)(?P<name2>[A-Za-z][^\s/>]*+)(?P<attrs2>[^>]*+)>"""
    r"""|</?[A-Za-z][^>]*\Z|[^<]++|<""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_TELLING = re.compile(r"class|id|role|hidden|style", re.I)
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_END_OF = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
_OTHER = 0x9E3779B97F4A7C15
_memo: dict[tuple, tuple[int, int]] = {}


def hashed(parent: int, name: str) -> int:
    """A signed 64-bit token for a name in a context."""
    n = xxhash.xxh3_64_intdigest(name.encode("utf-8", "surrogatepass"), parent & 0xFFFFFFFFFFFFFFFF)
    return n - (1 << 64) if n >> 63 else n


def end_of(token: int) -> int:
    n = (token & 0xFFFFFFFFFFFFFFFF) ^ _OTHER
    return n - (1 << 64) if n >> 63 else n


def _element(parent: int, name: str, attrs: str, inside: bool) -> tuple[int, int]:
    """Token and mark of an element. Classes and ids tell elements apart, but for those whose names pages make of their own address."""
    key = (parent, name, attrs, inside)
    known = _memo.get(key)
    if known:
        return known
    found: dict[str, str] = {}
    if attrs and _TELLING.search(attrs):
        for k, v in _ATTRIBUTE.findall(attrs):
            found.setdefault(k.lower(), v.strip("\"'"))
    label = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    words = {w.lower() for w in _NAME_PART.findall(label)}
    mark = NONE
    if name in NEVER or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        mark = HARD
    elif name in PARTS:
        mark = HARD if words & {"comment", "comments", "reply"} else NONE
    elif name == "form":
        mark = SOFT
    elif name not in ("html", "body"):
        mark = SOFT if words & WORDS or not inside and (name == "header" or words & PAGE_HEADER) else NONE
    shown = "" if name in ("html", "body", *PARTS) else _DIGITS.sub("", ".".join(sorted(label.split())))
    known = hashed(parent, f"{name} {shown}"), mark
    if len(_memo) > 100_000:
        _memo.clear()
    _memo[key] = known
    return known


def parse(html: str) -> list[tuple]:
    """(START, token, name, mark), (END, token, name) and (TEXT, path, text, mark, in a link) in page order; text has its references decoded."""
    out: list[tuple] = []
    stack: list[tuple] = [(0, "", NONE, False, False)]  # token, name, mark, in a link, in an article or main

    def end(depth: int) -> None:
        while len(stack) > depth:
            token, name, *_ = stack.pop()
            out.append((END, end_of(token), name))

    def end_implied(closes: frozenset, until: frozenset) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            name = stack[depth][1]
            if name in closes:
                return end(depth)
            if name in until:
                return None

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m["name"] or m["name2"]
        if name is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                token, _, mark, link, _ = stack[-1]
                out.append((TEXT, token, entities.unescape(text) if "&" in text else text, mark, link))
            continue
        name = name.lower()
        if m["end"] or m["end2"]:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == name), 0)
            if depth:
                end(depth)
            continue
        if stack[-1][1] == "head" and name not in IN_HEAD:
            end(len(stack) - 1)
        if name in ENDS:
            end_implied(*ENDS[name])
        if name not in INLINE and name not in VOID and name not in IN_HEAD:
            end_implied(*_PARAGRAPH)
        parent, _, mark, link, inside = stack[-1]
        attrs = m["attrs"] if m["name"] else m["attrs2"]
        token, own = _element(parent, name, attrs, inside)
        if name in PARTS and own != HARD and mark == SOFT:
            mark = NONE
        mark = max(mark, own)
        out.append((START, token, name, mark))
        if name in RAW:
            close = _END_OF[name].search(html, at)
            at = html.find(">", close.end()) + 1 or size if close else size
            out.append((END, end_of(token), name))
        elif name not in VOID:
            stack.append((token, name, mark, link or name == "a", inside or (name in PARTS and mark != HARD)))
    end(1)
    return out
