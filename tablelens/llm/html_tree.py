"""Pages as trees of block elements: what the graphical model labels."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# The elements of HTML that matter for the shape of the tree.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr caption ul".split()
)
DROPPED = frozenset("head title script style noscript template textarea select button iframe object svg math canvas video audio datalist map xmp noframes noembed".split())
RAW = frozenset("script style textarea title xmp noscript noframes noembed iframe".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
#: A start tag of the first kind closes an open one of the second, not beyond the third.
CLOSING = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th", "caption"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption"]), frozenset(["table"])),
}
NO_P = frozenset("body td th caption li tr tbody thead tfoot legend dd dt".split())  # an open p stays open inside these only if it is above them
CELLS = frozenset(["td", "th", "caption", "table"])

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>|</?([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|itemprop|aria-hidden|data-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+|\d+")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[str] = field(default_factory=list)
    label: str = ""
    words: int = 0  # of the subtree
    linked: int = 0  # of these, in links
    own: int = 0  # words directly in the element
    stops: int = 0  # ends of sentences directly in the element
    children: int = 0


@dataclass
class Page:
    nodes: list[Node]
    runs: list[tuple[int, str]]  # (element, text) of each block of text, in the order of the page


def parse(source: str) -> Page:
    """The tree of a page; its first node is the body."""
    nodes, runs = [Node("body", -1, 0)], []
    open_: list[int] = [0]
    text: list[str] = []
    linked: list[str] = []
    in_link, skip, at = False, "", 0
    depth_dropped = 0

    def flush() -> None:
        if text:
            # a reference is decoded before white space is: &nbsp; and &#10; are white space too
            words = html.unescape("".join(text)).split()
            if words:
                node = nodes[open_[-1]]
                node.own += len(words)
                node.stops += sum(w[-1] in ".!?;:…。" for w in words)
                node.words += len(words)
                node.linked += len(" ".join(linked).split())
                runs.append((open_[-1], " ".join(words)))
            text.clear()
            linked.clear()

    def pop_to(kinds, barrier) -> bool:
        for k in range(len(open_) - 1, 0, -1):
            tag = nodes[open_[k]].tag
            if tag in kinds:
                flush()
                del open_[k:]
                return True
            if tag in barrier:
                return False
        return False

    for m in _TAG.finditer(source):
        if m.start() < at:
            continue
        if m.start() > at and not depth_dropped:
            part = source[at : m.start()]
            text.append(part)
            if in_link:
                linked.append(part)
        at = m.end()
        name = m[1] or m[3]
        if not name or not source.endswith(">", 0, at):
            continue  # a comment, a declaration, or a tag that the page's end cuts off
        tag, end = name.lower(), source[m.start() + 1] == "/"
        if tag in DROPPED:
            if end:
                if tag == skip:
                    depth_dropped -= 1
                    skip = skip if depth_dropped else ""
            elif tag in RAW:
                close = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
                stop = source.find(">", close.start()) if close else -1
                at = stop + 1 if stop >= 0 else len(source)
            elif not (m[2] or m[4] or "").endswith("/") and (not skip or tag == skip):
                skip = tag
                depth_dropped += 1
            continue
        if tag == "body" and depth_dropped and skip == "head":
            skip, depth_dropped = "", 0
        if depth_dropped:
            continue
        if tag == "body":
            if not end and (attributes := m[2] or m[4]):
                _describe(nodes[0], attributes)
        elif tag == "a":
            in_link = not end
        elif tag == "br":
            text.append(" ")
        elif tag not in BLOCKS:
            continue
        elif end:
            pop_to(HEADINGS if tag in HEADINGS else (tag,), CELLS - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else ())
        else:
            if tag not in NO_P:
                pop_to(("p",), CELLS)
            if tag in CLOSING:
                pop_to(*CLOSING[tag])
                if tag in ("tr", "tbody", "thead", "tfoot"):
                    while pop_to(*CLOSING[tag]):
                        pass
            elif tag in HEADINGS and nodes[open_[-1]].tag in HEADINGS:
                pop_to(HEADINGS, ())
            flush()
            if tag == "hr":
                continue
            parent = open_[-1]
            node = Node(tag, parent, nodes[parent].depth + 1)
            nodes[parent].children += 1
            if attributes := m[2] or m[4]:
                _describe(node, attributes)
            nodes.append(node)
            open_.append(len(nodes) - 1)
            in_link = in_link and tag not in ("nav", "article", "footer", "header", "ul", "ol", "p")
    if at < len(source) and not depth_dropped:
        text.append(source[at:])
    flush()
    for node in reversed(nodes[1:]):  # children come after their parents
        nodes[node.parent].words += node.words
        nodes[node.parent].linked += node.linked
    return Page(nodes, runs)


def _describe(node: Node, attributes: str) -> None:
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "data-label":
            node.label = value
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            node.tokens.append("hidden")
        else:
            node.tokens += _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value).lower())


def features(page: Page, i: int) -> list[str]:
    """Names of what holds for a node."""
    n = page.nodes[i]
    parent = page.nodes[n.parent] if n.parent >= 0 else None
    size = lambda k: min(7, k.bit_length())
    density = min(3, int(4 * n.linked / n.words)) if n.words else 4
    return [
        "bias",
        f"tag {n.tag}",
        f"words {size(n.words)}",
        f"own {size(n.own)}",
        f"links {density}",
        f"stops {min(3, n.stops)}",
        f"children {size(n.children)}",
        f"tag {n.tag} links {density}",
        f"in {parent.tag if parent else 'none'} {n.tag}",
        *{f"token {t}" for t in n.tokens},
    ]
