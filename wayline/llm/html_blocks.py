"""Leaf blocks of an HTML page: their text and the marks of their ancestors and of the text itself."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from typing import NamedTuple

#: A worker remembers the marks of so many different opening tags and masks.
MEMO = 50_000

# Fixed values of the HTML standard: elements by how a parser treats them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style template iframe noembed noframes title textarea select".split())
BLOCKS = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul video audio canvas label xmp".split()
)
CLOSES_P = BLOCKS - {"html", "body", "head", "button", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "label", "legend"}
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
    "option": ({"option"}, {"select"}),
    "a": ({"a"}, BLOCKS),
}
FOREIGN = {"svg", "math"}
#: Parts of a drawing or formula with HTML inside.
HTML_PARTS = set("foreignobject desc mi mo mn ms mtext annotation-xml".split())
P_SCOPE = {"button", "td", "th", "caption", "table", "html", "body", "object"} | HTML_PARTS
#: An open drawing or formula ends before these.
LEAVES_FOREIGN = set("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: End tags that close blocks inside their element.
CLOSES_BLOCKS = BLOCKS | {"object"}

#: Marks of an element by its tag.
TAG_MARKS = {
    "nav": "nav", "menu": "nav", "header": "header", "hgroup": "heading", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "dialog": "notice",
    "button": "button", "label": "form", "legend": "form", "article": "article", "main": "main", "section": "section", "figure": "figure", "figcaption": "figure", "address": "address",
    "ul": "list", "ol": "list", "dl": "list", "li": "item", "table": "table", "td": "cell", "th": "cell", "p": "p", "pre": "pre", "xmp": "pre", "blockquote": "quote",
    "h1": "h1", "h2": "heading", "h3": "heading", "h4": "heading", "h5": "heading", "h6": "heading", "head": "head", "details": "details", "summary": "details", "div": "div",
}
#: Marks of an element by the words of its class, id and role.
NAME_MARKS = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs pagination pager pages toc tabs skip sitemap links toolbar",
    "header": "header masthead topbar banner branding logo top sitehead",
    "footer": "footer foot colophon copyright legal imprint bottom",
    "aside": "sidebar side aside rail widget widgets related recommended recommendations popular trending recent more secondary complementary teaser teasers promo promos",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored sponsors promotion adsense dfp outbrain taboola commercial",
    "comment": "comment comments commentlist discussion replies reply respond disqus reviews review reactions thread guestbook feedback",
    "notice": "cookie cookies consent gdpr notice notices alert alerts popup modal overlay banner announcement newsletter subscribe subscription signup paywall warning toast message dialog alertdialog",
    "form": "form search searchbox login signin register contact input field",
    "share": "share sharing social follow like tweet facebook twitter whatsapp",
    "content": "content article post story entry main body text page read single blog maintext bodytext articlebody",
    "meta": "meta byline author date published tags tag category categories byline info",
}
WORD_MARKS = {w: mark for mark, words in NAME_MARKS.items() for w in words.split()}
#: A name with one of these beside another word, as in has-sidebar or menu-open, tells of the page's state, not of the element.
STATE_WORDS = set("has with without no not is js open opened closed enabled disabled active inactive fixed sticky static visible shown collapsed expanded loaded logged template layout theme mode".split())
#: An element with the page's first h1 (or h2, if it has no h1) and so many longer texts that are no links is a wrapper, whatever its name says; how many words are long.
WRAPPER_TEXTS, WRAPPER_WORDS = 2, 8
#: Marks of a text by its words, in the languages of the training pages.
TEXT_MARKS = {
    "says_cookie": "cookie cookies consent gdpr datenschutz privacy confidentialité privacidad",
    "says_rights": "© copyright rights reserved rechte vorbehalten tous droits todos derechos impressum terms",
    "says_join": "subscribe newsletter sign login log register anmelden abonnieren suscribirse inscription email",
    "says_reply": "reply replies comment comments kommentar kommentare commentaire commentaires comentario comentarios antworten répondre responder",
    "says_ad": "advertisement advert sponsored sponsor anzeige werbung publicité publicidad buy discount off",
    "says_share": "share tweet facebook twitter teilen partager compartir follow",
    "says_more": "related recommended trending mehr lesen lire aussi leer more read also",
}
SAYS = {w: mark for mark, words in TEXT_MARKS.items() for w in words.split()}
#: A text of any length has such a mark when one of so many of its words, at least, is in the list.
SAYS_EVERY = 25
WORD_STEPS, LINK_STEPS = (2, 5, 10, 25, 60), (0.0, 0.3, 0.7, 0.99)
MARKS = [
    *[f"in_{m}" for m in sorted({*TAG_MARKS.values(), *NAME_MARKS})], *[f"nearest_{m}" for m in sorted({*TAG_MARKS.values(), *NAME_MARKS})],
    *[f"own_{m}" for m in sorted(set(TAG_MARKS.values()))], "hidden", "in_state", "in_replies", "first_heading", *TEXT_MARKS,
    *[f"words_{k}" for k in range(len(WORD_STEPS) + 1)], *[f"links_{k}" for k in range(len(LINK_STEPS) + 1)], "sentence_end", "no_capital", "first", "bias",
]
BIT = {m: 1 << k for k, m in enumerate(MARKS)}
#: Ancestors of these kinds decide about what is inside; the nearest one is a mark of its own.
DECIDING = {"nav", "header", "footer", "aside", "form", "ad", "comment", "notice", "share", "article", "main", "content", "head"}
_NEAREST_BITS = sum(v for k, v in BIT.items() if k.startswith("nearest_"))
_OWN_BITS = sum(v for k, v in BIT.items() if k.startswith("own_"))

_TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>"'=]++|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+)>|<[!?/][^>]*>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")


class Block(NamedTuple):
    text: str
    marks: int


class Marks(NamedTuple):
    """What an element hands down by its tag and by its names, and the parts of these that can be the nearest deciding mark."""

    by_tag: int
    by_name: int
    nearest_tag: int
    nearest_name: int


_CONTENT = BIT["in_content"] | BIT["nearest_content"]
_tag_memo: dict[tuple[str, str], Marks] = {}


def _name_marks(tag: str, attributes: str) -> tuple[list[str], bool]:
    """The marks of the words of an element's names, and whether a name tells of a state; those of the whole page are all states."""
    found, state = [], False
    for m in _NAMES.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            words = [w.lower() for w in _SPLIT.split(name) if w]
            known = [WORD_MARKS[w] for w in words if w in WORD_MARKS]
            if known and (tag in ("html", "body") or len(words) > 1 and not STATE_WORDS.isdisjoint(words)):
                state = True
            else:
                found += known
    return found, state


def _tag_marks(tag: str, attributes: str) -> Marks:
    key = (tag, attributes)
    if (held := _tag_memo.get(key)) is not None:
        return held
    names, state = _name_marks(tag, attributes)
    bits = lambda marks, kind: sum({BIT[f"{kind}_{m}"] for m in marks})
    deciding = lambda marks: [m for m in marks if m in DECIDING]
    own = [TAG_MARKS[tag]] if tag in TAG_MARKS else []
    by_tag = bits(own, "in") | (BIT["hidden"] if _HIDDEN.search(attributes) else 0) | (BIT["in_state"] if state else 0)
    out = Marks(by_tag, bits(names, "in"), bits(deciding(own), "nearest"), bits(deciding(names), "nearest"))
    if len(attributes) < 200:
        if len(_tag_memo) >= MEMO:
            _tag_memo.clear()
        _tag_memo[key] = out
    return out


_SAYS_BITS = {w: BIT[mark] for w, mark in SAYS.items()}
_WORDS_BITS = [BIT[f"words_{k}"] for k in range(len(WORD_STEPS) + 1)]
_SAYS_STARTS = {w[0] for w in SAYS} | {"("}
_LINKS_BITS = [BIT[f"links_{k}"] for k in range(len(LINK_STEPS) + 1)]


def _text_marks(text: str, linked: int, first: bool) -> int:
    words = text.count(" ") + 1
    mask = BIT["bias"] | _WORDS_BITS[bisect_left(WORD_STEPS, words)] | (_LINKS_BITS[bisect_left(LINK_STEPS, linked / len(text))] if linked else _LINKS_BITS[0])
    if text[-1] in ".!?…:»”\"'":
        mask |= BIT["sentence_end"]
    if not text[0].isupper():
        mask |= BIT["no_capital"]
    if first:
        mask |= BIT["first"]
    said: dict[int, int] = {}
    for word in text.lower().split(" "):
        if word[:1] in _SAYS_STARTS and (bit := _SAYS_BITS.get(word.strip(".,:;!?()"))):
            said[bit] = said.get(bit, 0) + 1
    for bit, n in said.items():
        if n * SAYS_EVERY >= words:
            mask |= bit
    return mask


def leaf_blocks(page: str | None) -> list[Block]:
    """The page's blocks in order: maximal runs of text without a block's start or end between.

    Character references are decoded and white space inside a block, ``<br>`` included, becomes one
    space. Unclosed and stray tags are taken as browsers take them, in outline: a block start closes
    an open ``<p>``, a list item the item before it, an end tag all that is open inside its element,
    at any depth. Scripts, styles, templates, frames, titles and form controls hold no text; unclosed they take the
    rest of the page, but for ``<select>``. Fallback texts, formulas and drawings are text like any
    other, and ``<xmp>`` is taken to the letter. Text outside any element is a block too.
    """
    if not page:
        return []
    last = page.rfind(">") + 1
    tail = re.search(r"<[A-Za-z/!?]", page[last:])
    source, rest = page[:last], page[last : last + tail.start()] if tail else page[last:]
    found: list[tuple[str, int, int]] = []  # text, its node, its own marks
    # the elements that hand marks down: the node above, and their marks
    nodes: list[tuple[int, Marks]] = [(0, Marks(0, 0, 0, 0))]
    # (tag, node, open p or -1, open drawing or formula or -1, nearest block or 0)
    stack: list[tuple[str, int, int, int, int]] = [("", 0, -1, -1, 0)]
    opened: dict[str, list[int]] = {}
    pieces: list[str] = []
    linked: list[str] = []
    lower: str | None = None
    endless: set[str] = set()

    def flush() -> None:
        nonlocal pieces, linked
        if pieces and (text := " ".join("".join(pieces).split())):
            own = TAG_MARKS.get(stack[stack[-1][4]][0])
            found.append((text, stack[-1][1], (BIT[f"own_{own}"] if own else 0) | _text_marks(text, sum(map(len, linked)), not found)))
        pieces, linked = [], []

    def say(text: str, literal: bool = False) -> None:
        if text:
            text = html.unescape(text) if "&" in text and not literal else text
            pieces.append(text)
            if opened.get("a"):
                linked.append(text)

    def close(k: int) -> None:
        for tag, *_ in stack[k:]:
            opened[tag].pop()
        del stack[k:]

    def end_of(tag: str) -> int:
        """Where the end tag of a raw element starts, or -1."""
        nonlocal lower
        if tag in endless:
            return -1
        lower = source.lower() if lower is None else lower
        if len(lower) != len(source):  # a few letters change their length
            found = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(source, at)
            end = found.start() if found else -1
        else:
            end = lower.find(f"</{tag}", at)
        if end < 0:
            endless.add(tag)
        return end

    at = 0
    while m := _TOKEN.search(source, at):
        say(source[at : m.start()])
        at = m.end()
        if not m[2]:
            if at == len(source) and m[0].startswith("<!--") and not m[0].endswith(("-->", "--!>", "<!->")):
                rest = ""  # the comment is open
            continue
        tag = m[2].lower()
        block = tag in BLOCKS
        if block:
            flush()
        elif tag in ("br", "text"):
            pieces.append(" ")
        if m[1]:
            if (at_tag := opened.get(tag)) and (tag in CLOSES_BLOCKS or at_tag[-1] > stack[-1][4]):
                close(at_tag[-1])
            continue
        if stack[-1][3] > 0 and tag in LEAVES_FOREIGN:
            close(stack[-1][3])
        if tag in RAW and not m[3].endswith("/"):
            end = end_of(tag)
            if end >= 0 or tag != "select":
                if tag in ("title", "textarea", "select") and stack[-1][3] < 0:
                    flush()
                at = end if end >= 0 else len(source)
                if at == len(source):
                    rest = ""
                continue
        if tag in VOID or m[3].endswith("/") and (stack[-1][3] > 0 or tag in FOREIGN):
            continue
        if tag in CLOSES_P and (p := stack[-1][2]) > 0:
            close(p)
        if tag in CLOSES:
            same, within = CLOSES[tag]
            k = max(opened[t][-1] if opened.get(t) else 0 for t in same)
            if k and k > (stack[-1][4] if within is BLOCKS else max(opened[t][-1] if opened.get(t) else 0 for t in within)):
                close(k)
        marks, node = _tag_marks(tag, m[3]), stack[-1][1]
        if any(marks):
            nodes.append((node, marks))
            node = len(nodes) - 1
        foreign = -1 if tag in HTML_PARTS else len(stack) if tag in FOREIGN and stack[-1][3] < 0 else stack[-1][3]
        stack.append((tag, node, len(stack) if tag == "p" else -1 if tag in P_SCOPE else stack[-1][2], foreign, len(stack) if block else stack[-1][4]))
        opened.setdefault(tag, []).append(len(stack) - 1)
        if tag == "xmp" and (end := end_of(tag)) >= 0:
            say(source[at:end], literal=True)
            at = end
    say(source[at:] + rest)
    flush()
    heading = BIT["own_h1"] if any(marks & BIT["own_h1"] for _, _, marks in found) else BIT["own_heading"]
    if (k := next((k for k, b in enumerate(found) if b[2] & heading), None)) is not None:
        found[k] = (*found[k][:2], found[k][2] | BIT["first_heading"])
    handed = _handed_down(nodes, found)
    return [Block(text, handed[node] | marks) for text, node, marks in found]


def _handed_down(nodes: list[tuple[int, Marks]], found: list[tuple[str, int, int]]) -> list[int]:
    """The marks that each node hands down.

    Names of a wrapper, which holds the first heading and long texts, count only if they speak of content. An element that
    begins with a few words about replies is marked as theirs, whatever its name.
    """
    replies, begun = [False] * len(nodes), [False] * len(nodes)
    begun[0] = True
    for _, node, marks in found:
        few = bool(marks & BIT["says_reply"] and marks & (BIT["words_0"] | BIT["words_1"]))
        while not begun[node]:
            begun[node], replies[node], node = True, few, nodes[node][0]
    head, long = [0] * len(nodes), [0] * len(nodes)
    named = any(marks.by_name & ~_CONTENT for _, marks in nodes)
    if named:
        for text, node, marks in found:
            if marks & BIT["first_heading"]:
                head[node] = 1
            elif marks & _LINKS_BITS[0] and text.count(" ") + 1 >= WRAPPER_WORDS:
                long[node] += 1
        for k in range(len(nodes) - 1, 0, -1):
            head[nodes[k][0]] += head[k]
            long[nodes[k][0]] += long[k]
    out = [0] * len(nodes)
    for k in range(1, len(nodes)):
        above, (by_tag, by_name, nearest, nearest_name) = nodes[k]
        if named and head[k] and long[k] >= WRAPPER_TEXTS and by_name & ~_CONTENT:
            by_name, nearest_name = by_name & _CONTENT, nearest_name & _CONTENT
        marks = out[above] | by_tag | by_name | (BIT["in_replies"] if replies[k] else 0)
        nearest |= nearest_name
        out[k] = marks & ~_NEAREST_BITS | nearest if nearest else marks
    return out
