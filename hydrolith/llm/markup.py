"""Reads a page's markup into blocks of text with their place in the tree."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from functools import lru_cache

import xxhash

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>]*+)>|<[!?/][^>]*+>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
TELLING = re.compile(r"\b(?:class|id|role|itemprop|hidden|style)\b", re.IGNORECASE)
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: ASCII white space that is no space; a no-break space is text.
GAPS = re.compile(r"[\t-\r]")

#: Elements whose content is no markup.
RAW = frozenset("script style textarea title noscript iframe template svg math xmp noembed noframes object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block.
BLOCK = frozenset(
    "html head body article section main header footer nav aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th "
    "blockquote pre figure figcaption address form fieldset legend details summary hr center dialog menu hgroup search option select button".split()
)
#: Elements that a new block closes: a paragraph has no blocks in it.
ENDS_PARAGRAPH = BLOCK - frozenset("option select button".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What closes no further than these.
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Elements and ARIA roles that are never the article.
NOISE_TAGS = frozenset("head nav footer aside form button select dialog menu search".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words in a class or id that mark menus, notices, adverts and comments.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist disqus respond replies discussion share sharing social related recommended "
    "recommendations popular trending sidebar widget widgets menu nav navbar navigation breadcrumb breadcrumbs footer masthead pagination pager toolbar topbar copyright "
    "adbox adslot adsbygoogle cookiebar cookiebanner cookieconsent mainmenu navmenu sidenav subnav".split()
)
#: Of these, words that in an article may as well name a part of it: there the site's
#: tree decides.
DOUBTFUL_WORDS = frozenset("discussion menu promotion share sharing".split())
#: Words that say where or how such a part stands, not what it is.
FRAME_WORDS = frozenset(
    "box bar block list section area wrap wrapper container slot unit inner outer item items left right top bottom main site page global primary secondary header "
    "head body text content links link button buttons icon icons form panel module row column col sticky fixed inline small large posts post entry article articles story "
    "stories news more mobile desktop thread group holder zone region".split()
)
MAIN_WORDS = frozenset("content article post entry story main body text".split())
#: Elements that hold others; what they call themselves counts anywhere.
HOLDERS = frozenset("div section ul ol dl table tbody tr td figure center fieldset details address".split())
#: Elements of an article's own text.
FLOW = frozenset("article main p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption header hgroup #".split())

ARTICLE, MAIN, CUE = 4, 2, 1
DEEPEST = 512

#: What an element says of its importance, and how much that counts beside the tree's.
Prior = tuple[float, float]
NEUTRAL: Prior = (1.0, 0.0)
NOISE: Prior = (0.0, 0.8)
NAMED: Prior = (0.0, 0.7)
#: What is met on enough pages and never the same stays in spite of it; without
#: evidence from the tree it is noise.
DOUBTED: Prior = (0.0, 0.2)
OWN: Prior = (1.0, 0.5)


class Element:
    """A block element of a page, or an inline one while it is open."""

    __slots__ = ("tag", "key", "parent", "prior", "within", "block", "cut", "items")

    def __init__(self, tag: str, key: str, parent: Element | None, prior: Prior, within: int, block: bool, cut: bool):
        self.tag, self.key, self.parent, self.prior, self.within, self.block = tag, key, parent, prior, within, block
        self.cut = cut  # noise inside a line of text
        self.items: list[Element | Block] = []


@dataclass(slots=True, eq=False)
class Block:
    text: str
    parent: Element
    linked: float


def node_id(path: str) -> int:
    """A signed 64-bit name of a node of the site's tree."""
    return xxhash.xxh64_intdigest(path.encode("utf-8", "surrogatepass")) - (1 << 63)


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(raw)}


def named_noise(attrs: dict[str, str], within: int) -> set[str]:
    """The noise words of a class or the id that says noise and nothing else: each
    of its words is a noise or a frame word, and one is a noise word. Of several such
    names, the words of all."""
    found = set()
    for name in (*attrs.get("class", "").split(), attrs.get("id", "")):
        words = {w.lower() for w in TOKEN.findall(name) if len(w) > 1}
        if words <= NOISE_WORDS | FRAME_WORDS:
            found |= words & NOISE_WORDS or (words & {"header"} if words == {"header"} and not within else set())
    return found


@lru_cache(20_000)
def _kind(tag: str, named: str, within: int, cut: bool) -> tuple[str, Prior, int, bool]:
    """What an element is, by its tag, its attributes and what it stands in:
    its key, its prior, the containers it is in, whether its line is cut."""
    attrs = _attributes(named)
    words = {w.lower() for w in TOKEN.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")} if attrs else set()
    role = attrs.get("role", "").lower()
    noisy = named_noise(attrs, within) if attrs else set()
    outer = within
    if tag == "article" or "articlebody" in attrs.get("itemprop", "").lower():
        within |= ARTICLE
    if tag == "main" or role == "main":
        within |= MAIN
    if tag in ("div", "section", "td") and words & MAIN_WORDS and not noisy:
        within |= CUE
    hidden = "hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower()
    said = tag in NOISE_TAGS or role in NOISE_ROLES or tag == "header" and not within & (ARTICLE | MAIN)
    key = tag + "".join(f".{w}" for w in sorted(words)) if words else tag
    if tag not in BLOCK:
        return key, NEUTRAL, within, said or hidden or cut
    if said or hidden or noisy and tag in HOLDERS:
        prior = DOUBTED if not said and not hidden and outer & (ARTICLE | MAIN) and noisy <= DOUBTFUL_WORDS else NOISE
    elif noisy and not outer and tag not in ("html", "body", "main", "article"):
        prior = NAMED
    else:
        prior = OWN if within and tag in FLOW else NEUTRAL
    return key, prior, within, False


def blocks(page: str) -> tuple[Element, list[Block]]:
    """The page's root and all blocks with text, in page order; scripts, styles
    and comments give none. Tags that are not closed end where a browser would
    end them."""
    root = Element("", "", None, NEUTRAL, 0, True, False)
    stack = [root]
    out: list[Block] = []
    pieces: list[str] = []
    chars = linked = links = 0

    def flush() -> None:
        nonlocal pieces, chars, linked
        if pieces:
            text = "".join(pieces)
            if "&" in text:
                text = html.unescape(text)
            if GAPS.search(text):
                text = GAPS.sub(" ", text)
            while "  " in text:
                text = text.replace("  ", " ")
            text = text.strip(" ")
            if text:
                at = next(e for e in reversed(stack) if e.block)
                out.append(Block(text, at, linked / chars if chars else 0.0))
                at.items.append(out[-1])
        pieces, chars, linked = [], 0, 0

    def close(i: int) -> None:
        nonlocal links
        for e in stack[i:]:
            if e.block:
                flush()
                break
        if links:
            links -= sum(e.tag == "a" for e in stack[i:])
        del stack[i:]

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not stack[-1].cut:
            pieces.append(text)
            chars += len(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].block and tag not in BLOCK:
                    break
            continue
        attrs_raw = m[3] if m[2] else m[6]
        if tag in RAW:
            if not attrs_raw.endswith("/"):
                stop = re.compile(rf"</{tag}\b[^>]*>?", re.IGNORECASE).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            elif tag == "hr":
                flush()
            continue
        if tag in ENDS_PARAGRAPH:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].block:
                    break
        if tag in SAME:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SAME[tag]:
                    close(i)
                    break
                if stack[i].tag in FENCE[tag]:
                    break
        if tag in BLOCK:
            flush()
        if len(stack) > DEEPEST:  # as browsers do: deeper elements stand beside each other
            close(len(stack) - 1)
        top = stack[-1]
        key, prior, within, cut = _kind(tag, attrs_raw if attrs_raw and TELLING.search(attrs_raw) else "", top.within, top.cut)
        over = top if top.block else top.parent
        new = Element(tag, key, over, prior, within, tag in BLOCK, cut)
        stack.append(new)
        if new.block:
            over.items.append(new)
            if tag in ("article", "main"):  # a body that is one form, or wrapped in a header, still has its article
                while over is not None:
                    if over.tag in ("form", "header"):
                        over.prior = NEUTRAL
                    over = over.parent
        links += tag == "a"
    flush()
    return root, out
