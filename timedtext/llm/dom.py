"""The blocks of a web page: which element each text belongs to, and what its markup says about it."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import xxhash

#: Fixed values of HTML: elements without content, with raw text, and those that begin a new block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("""
    address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section select summary table tbody td template tfoot th thead tr ul
""".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li noscript optgroup option select tbody td template tfoot th thead tr".split())
_NOT_P = BLOCK - {"p"}
#: An element of these closes an open one of the second kind, if none of the third is in between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "option": (("option",), ("select", "datalist")),
}
#: Elements, roles and words of classes and ids that tell what is not the page's article.
ASIDE_TAGS = frozenset("aside button datalist dialog footer head menu nav noscript select svg template".split())
ASIDE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
ASIDE_WORDS = frozenset("""
    ad ads advert advertisement advertisements adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal
    nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion recommendations recommended related replies reply
    respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets
""".split())
_ATTRIBUTES = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Numbers of records; shorter ones may be of a layout.
_SERIAL = re.compile(r"\d{3,}")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The rest of a tag behind its name, with quoted values.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_CACHED = 100_000


class Block(NamedTuple):
    """A text and its element: the element's place in the tree, whether markup sets it aside, and 2 within an article, 1 within a main part, else 0."""

    node: int
    text: str
    aside: bool
    part: int


class _Open:
    __slots__ = ("block", "level", "node", "part", "style", "tag")

    def __init__(self, tag: str, node: int, block: bool, level: int, part: int, style: list[str]) -> None:
        self.tag, self.node, self.block, self.level, self.part, self.style = tag, node, block, level, part, style


_known: dict[tuple[str, str], tuple[str, int, int]] = {}
_nodes: dict[tuple[int, str], int] = {}


def _described(tag: str, attributes: str) -> tuple[str, int, int]:
    """Label of an element, 2 or 1 if it or what it is called sets it aside, and the part that it begins."""
    if (found := _known.get((tag, attributes))) is not None:
        return found
    names: set[str] = set()
    called: list[str] = []
    roles: set[str] = set()
    for m in _ATTRIBUTES.finditer(attributes):
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() in ("class", "id"):
            names.update(w.lower() for w in _WORD.findall(value))
            called += sorted(_SERIAL.sub("0", value).split())
        else:
            roles.update(value.lower().split())
    part = 2 if tag == "article" or "articlebody" in roles or "article" in roles else 1 if tag == "main" or "main" in roles else 0
    if tag in ASIDE_TAGS or roles & ASIDE_ROLES:
        level = 2
    elif tag in ("html", "body", "main"):
        level = 0
    else:
        level = int(bool(names & ASIDE_WORDS) or tag in ("form", "header"))
    if len(_known) > _CACHED:
        _known.clear()
    return _known.setdefault((tag, attributes), (".".join([tag, *called]), level, part))


def _below(node: int, label: str) -> int:
    found = _nodes.get((node, label))
    if found is None:
        if len(_nodes) > _CACHED:
            _nodes.clear()
        found = _nodes[node, label] = xxhash.xxh3_64_intdigest(f"{node} {label}".encode("utf-8", "surrogatepass")) >> 1
    return found


def walk(page: str) -> tuple[list[Block], list[tuple[int, str]]]:
    """The blocks of a page in order, and the presentation of each element with text: the names of what is in it, runs of one name once.

    Siblings with one label are one node. White space of a block is one blank,
    character references are decoded. Elements within inline ones count for the block
    around them. What markup cuts off (an open comment, tag or script) ends the page.
    """
    blocks: list[Block] = []
    styles: list[tuple[int, str]] = []
    stack = [_Open("", 0, True, 0, 0, [])]
    counts: dict[str, int] = {}
    buffer: list[str] = []
    at, n, quoted = 0, len(page), True

    def flush() -> None:
        if buffer:
            raw = "".join(buffer)
            buffer.clear()
            text = " ".join((html.unescape(raw) if "&" in raw else raw).split())
            if text:
                top = stack[-1]
                blocks.append(Block(top.node, text, top.level > 0, top.part))
                top.style.append("#")

    def pop(to: int) -> None:
        while len(stack) > to:
            top = stack[-1]
            if top.block or top.level != stack[-2].level:
                flush()
            stack.pop()
            counts[top.tag] -= 1
            if top.block and "#" in top.style:
                styles.append((top.node, " ".join(x for i, x in enumerate(top.style) if x != "#" and (not i or x != top.style[i - 1]))))

    def close(tags: tuple[str, ...], within: frozenset[str] | tuple[str, ...]) -> None:
        if any(counts.get(t) for t in tags):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in tags:
                    return pop(i)
                if stack[i].tag in within:
                    return None
        return None

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            buffer.append(page[at:])
            break
        if begin > at:
            buffer.append(page[at:begin])
        at = begin + 1
        ending = page.startswith("/", at)
        name = _NAME.match(page, at + ending)
        if name is None:
            if page.startswith("!--", at):
                end = page.find("-->", at + 1)
                at = end + 3 if end >= 0 else n
            elif ending or page[at : at + 1] in ("!", "?"):
                end = page.find(">", at)
                at = end + 1 if end >= 0 else n
            else:
                buffer.append("<")
            continue
        rest = _REST.match(page, name.end()) if quoted else None
        if rest is not None:
            end = rest.end()
        else:
            # a quote that never ends: from here on the first > ends a tag
            quoted = False
            end = page.find(">", name.end()) + 1
            if not end:
                break
        tag = name[0].lower()
        attributes = page[name.end() : end - 1]
        at = end
        if ending:
            if tag in ("body", "html"):
                flush()
            elif counts.get(tag):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        pop(i)
                        break
            continue
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = page.find(">", m.end()) + 1 if m else n
            at = at or n
            continue
        block = tag in BLOCK
        if block:
            flush()
            if tag in CLOSES_P:
                close(("p",), _NOT_P)
            if tag in CLOSES:
                close(*CLOSES[tag])
        top = stack[-1]
        top.style.append(tag)
        if tag in VOID:
            if tag in ("br", "hr"):
                buffer.append(" ")
            continue
        label, own, part = _described(tag, attributes.strip())
        if part and not (own and tag != "main"):
            level = 2 if top.level == 2 else 0  # a container is not set aside for its name if the article is in it
        else:
            level = max(top.level, 0 if tag == "header" and top.part and own == 1 else own)
            part = 0 if own else part
        if not block and level != top.level:
            flush()
        if attributes.endswith("/") and not block:
            continue
        stack.append(_Open(tag, _below(top.node, label) if block else top.node, block, level, max(part, top.part), [] if block else top.style))
        counts[tag] = counts.get(tag, 0) + 1
    flush()
    pop(1)
    return blocks, styles
