"""Main text of web pages by composite text density.

The page becomes a DOM. Every node counts its characters and tags, and those inside links; its density is characters per
tag, cut down where links make up much of it or its neighbourhood (Sun, Song and Liao, 2011). The node whose children's
densities have the largest sum holds the article; the lowest density on the way from it up to the body is the threshold
from which on other blocks are kept too, with the headings before them.

Names and class words are evidence, weighed before the measure (`_weighed`): scripts, hidden elements and controls never count; an element whose name or whole class word says
that it is a menu, an advert or the like goes unless it holds the article element; a word that only may say so ("side-effects", a section's id) lets an element go that
is made of links or has no block of text; headings, paragraphs and cells are judged by their class only, and only by words that can't mean anything else. Elements end
where their parents do. A page that is left without text is read again without class words, then without names.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import chunks, tuned

#: Element names by role; words in class, id or role that mark what is not article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp svg".split())
NEVER = frozenset("head button select dialog".split())
NAMED = frozenset("nav header footer aside form menu".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead caption blockquote pre figure figcaption span a b i em strong small u".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("body div article section main ul ol dl table td th html".split())
KEPT = frozenset("html body article main".split())
NOISE = re.compile(
    r"(?<![a-z])(?:ads?|advert|adverts|advertisement|adsense|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|notice|banner|sidebar|side|menu|nav|navbar|navigation|breadcrumb|breadcrumbs"
    r"|footer|header|masthead|contentinfo|complementary|search|comment|comments|commentlist|disqus|respond|replies|reply|share|sharing|social|related|recommended|widget|newsletter|subscribe|signup|popup|modal|login|toolbar|pagination|pager)(?![a-z])"
)
#: Those of NOISE that name nothing else, also as part of a longer word.
CLEAR = re.compile(r"(?<![a-z])(?:ads?|advert|adverts|advertisement|adsense|sponsor|sponsored|promo|cookie|cookies|consent|gdpr|comment|comments|commentlist|disqus|share|sharing|newsletter|breadcrumb|breadcrumbs|pagination|pager)(?![a-z])")
#: What a tag starts with; its attributes with quotes in pairs; without regard to quotes; what else markup can be.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_HINT = re.compile(r"(?:^|\s)(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none", re.IGNORECASE)
_WHITE = re.compile(r"\s+")
#: Class words that say what a page has around its text ("with-sidebar") mark nothing.
_STATE = re.compile(r"(?:with|without|has|have|no|not|is|hide|show|enable|disable)[-_]|.*[-_](?:open|closed|enabled|disabled|on|off)$")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


#: What speaks against an element: a word that may mean it, its name or a whole word, or what never is text. Characters of a block of text; links of a block's characters.
MAYBE, LIKELY, CERTAIN = 1, 2, 3
BLOCK_CHARS, LINK_SHARE = 80, 0.4


class Node:
    __slots__ = ("tag", "up", "first", "last", "chars", "tags", "link_chars", "link_tags", "kids", "density", "mark")

    def __init__(self, tag: str, up: Node | None, first: int) -> None:
        self.tag, self.up, self.first, self.last = tag, up, first, first
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.kids: list[Node] = []
        self.density = 0.0
        self.mark = 0


def noise(tag: str, attrs: str) -> int:
    """What class, id, role and label of an element say against it."""
    most = 0
    for kind, *values in _HINT.findall(attrs):
        kind = kind.lower()
        for w in (values[0] or values[1] or values[2]).lower().split():
            m = NOISE.search(w)
            if not m or _STATE.match(w):
                continue
            whole, clear = m[0] == w, CLEAR.search(w) is not None
            if tag in TEXTUAL:
                says = LIKELY if kind == "class" and whole and clear and tag not in HEADINGS else 0
            elif kind == "aria-label":
                says = MAYBE
            elif tag == "section" and kind == "id":
                says = LIKELY if whole and clear else MAYBE if whole else 0
            else:
                says = LIKELY if whole or clear else MAYBE
            most = max(most, says)
    return most


class _Open:
    """The open elements, with the places of each name, so that a look-up doesn't walk the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.at, self.scopes = [root], defaultdict(list), []

    def push(self, node: Node) -> None:
        self.at[node.tag].append(len(self.stack))
        if node.tag in SCOPE:
            self.scopes.append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> Node:
        node = self.stack.pop()
        self.at[node.tag].pop()
        if node.tag in SCOPE:
            self.scopes.pop()
        return node

    def find(self, tags: tuple[str, ...], through: bool) -> int:
        """The place of the last open element of these names, 0 if there is none or, unless through, if an element of SCOPE lies above it."""
        k = max((self.at[t][-1] for t in tags if self.at[t]), default=0)
        return k if through or not self.scopes or self.scopes[-1] <= k else 0


def parse(page: str, by_class: bool = True, by_name: bool = True) -> tuple[Node, list[str | None]]:
    """The DOM without what is left out, and its texts in order; None is a block's edge.

    Without by_class no class word says anything against an element, without by_name no name of a container. The time is linear in the page's length: a tag with a quote that is
    open up to the page's end ends at its first ">", and so do all tags after it, whatever their quotes.
    """
    root = Node("#", None, 0)
    open_, events, at, links = _Open(root), [], 0, 0
    n, last, quotes = len(page), page.rfind(">"), True
    stack = open_.stack

    def text(s: str) -> None:
        if s:
            events.append(s)
            chars = len(_WHITE.sub("", s))
            stack[-1].chars += chars
            if links:
                stack[-1].link_chars += chars

    def close(depth: int) -> None:
        nonlocal links
        while len(stack) > depth:
            node = open_.pop()
            node.last = len(events)
            links -= node.tag == "a"
            if node.mark:
                events.append(None)

    while at < n:
        begin = page.find("<", at)
        if begin < 0 or begin > last:
            text(page[at:].partition("<!--")[0])
            break
        text(page[at:begin])
        if page.startswith("<!--", begin):
            at = page.find("-->", begin + 4)
            at = n if at < 0 else at + 3
            continue
        m = _TAG.match(page, begin)
        if not m:
            at = begin + 1
            if page[at : at + 1] in ("!", "?", "/"):
                at = page.index(">", at) + 1
            else:
                text("<")
            continue
        end = _QUOTED.match(page, m.end()) if quotes else None
        quotes = end is not None
        at = end.end() if end else page.index(">", m.end()) + 1 if m.end() <= last else n
        shut, tag, attrs = m[1], m[2].lower(), page[m.end() : at - 1]
        if shut:
            if k := open_.find((tag,), tag in BLOCK):
                close(k)
            if tag in BLOCK:
                events.append(None)
            continue
        if tag not in IN_HEAD and (k := open_.find(("head",), True)):
            close(k)
        if tag in RAW:
            # Up to the last ">", so that the first closing tag that is found also ends.
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.IGNORECASE).search(page, at, last + 1)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag in BLOCK:
                events.append(None)
            stack[-1].tags += 1
            continue
        if tag in ("html", "body") and open_.at[tag]:
            continue
        if k := open_.find(("p",) if tag in CLOSES_P else SAME.get(tag, ()), False):
            close(k)
        mark = 0
        if tag not in KEPT:
            mark = CERTAIN if tag in NEVER or _HIDDEN.search(attrs) else LIKELY if tag in NAMED and by_name else noise(tag, attrs) if by_class else 0
        if tag in BLOCK or mark:
            events.append(None)
        node = Node(tag, stack[-1], len(events))
        node.mark = mark
        stack[-1].kids.append(node)
        open_.push(node)
        links += tag == "a"
    close(1)
    root.last = len(events)
    return _weighed(root, events), events


def _weighed(root: Node, events: list[str | None]) -> Node:
    """Takes out the elements that what speaks against them weighs more than what they hold, with their texts; children go with their parents.

    What they hold is an article or main element, or blocks of BLOCK_CHARS characters; a form, which may be around a whole page, also another of the page's parts.
    """
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.kids
    if not any(x.mark for x in order):
        return root
    chars, linked = {id(x): x.chars for x in order}, {id(x): x.link_chars for x in order}
    own, blocks, article, parts = {id(x): x.chars for x in order}, defaultdict(int), set(), set()
    for x in reversed(order):
        k, up = id(x), id(x.up)
        block = x.tag in BLOCK or x.mark
        blocks[k] += block and own[k] >= BLOCK_CHARS
        if x.up is not None:
            chars[up] += chars[k]
            linked[up] += linked[k]
            blocks[up] += blocks[k]
            own[up] += 0 if block else own[k]
            if k in article or x.tag in ("article", "main"):
                article.add(up)
            if k in parts or x.tag in ("h1", "nav", "header", "footer"):
                parts.add(up)

    def goes(x: Node) -> bool:
        k = id(x)
        if x.mark == CERTAIN or not x.mark:
            return x.mark == CERTAIN
        if k in article or x.tag == "form" and (k in parts or blocks[k] > 1):
            return False
        return x.mark == LIKELY or not blocks[k] or linked[k] > LINK_SHARE * chars[k]

    for x in order:
        gone = [k for k in x.kids if k.mark and goes(k)]
        if gone:
            out = set(map(id, gone))
            x.kids = [k for k in x.kids if id(k) not in out]
            for k in gone:
                events[k.first : k.last] = [None] * (k.last - k.first)
    return root


def _measure(root: Node) -> list[Node]:
    """All nodes, children first, with their counts and densities."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += node.kids
    order.reverse()
    for node in order:
        if node.up is not None:
            node.up.chars += node.chars
            node.up.link_chars += node.link_chars
            node.up.tags += node.tags + 1
            node.up.link_tags += node.link_tags + (node.tag == "a")
    body = next((x for x in reversed(order) if x.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for x in order:
        c, lc, t, lt = x.chars, x.link_chars, max(x.tags, 1), max(x.link_tags, 1)
        if c:
            plain = max(c - lc, 1)
            base = math.log(c / plain * lc + share * c + math.e)
            x.density = c / t * max(0.0, math.log(c / max(lc, 1) * t / lt + 1e-9) / math.log(max(base, 1.0) + 1e-6) if base > 1 else math.log(c / max(lc, 1) * t / lt + 1))
    return order


def main_nodes(root: Node) -> list[Node]:
    """The nodes that hold the article, in document order; none lies in another."""
    order = _measure(root)
    body = next((x for x in reversed(order) if x.tag == "body"), root)
    best = max(reversed(order), key=lambda x: sum(k.density for k in x.kids) or (x.density if not x.kids else 0.0))
    path, x = [best], best
    while x is not body and x.up is not None:
        x = x.up
        path.append(x)
    # The whole of the nearest article or main belongs to it, if that is denser than the page.
    main = next((k for k, up in enumerate(path) if k and up.tag in ("article", "main") and up.density >= body.density), 0)
    least = min(x.density for x in path)
    kept, todo = [], [path[-1]]
    above = {id(x) for x in path[main + 1 :]}
    while todo:
        x = todo.pop()
        if x is path[main] or (id(x) not in above and x.tag in BLOCK and x.chars and x.density >= least):
            kept.append(x)
        else:
            todo += reversed(x.kids)
    # A heading goes with the kept block that comes next.
    own = {id(x) for x in kept}
    out, todo = [], [path[-1]]
    while todo:
        x = todo.pop()
        if id(x) in own:
            out.append(x)
            continue
        todo += reversed(x.kids)
        if id(x) in above or x is path[-1]:
            follows = False
            for k in reversed(x.kids):
                if k.chars and id(k) not in own:
                    follows = follows and _heading(k)
                    if follows:
                        own.add(id(k))
                follows = follows or id(k) in own
    return out


def _heading(x: Node) -> bool:
    """Whether all text of x is in headings."""
    todo = [x]
    while todo:
        x = todo.pop()
        if x.tag not in HEADINGS:
            if x.chars > sum(k.chars for k in x.kids):
                return False
            todo += [k for k in x.kids if k.chars]
    return True


#: Decimal references: zeros in front, and numbers over every code point, which html.unescape can't convert if very long.
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


def decoded(text: str) -> str:
    return html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)) if "&#" in text else text)


def extract(page: str) -> str:
    """The main text; if what class words and names say leaves none, the main text without regard to the former, then to both."""
    return _extract(*parse(page)) or _extract(*parse(page, by_class=False)) or _extract(*parse(page, by_class=False, by_name=False))


def _extract(root: Node, events: list[str | None]) -> str:
    blocks, now = [], []
    for e in (e for node in main_nodes(root) for e in [*events[node.first : node.last], None]):
        if e is None:
            if now:
                blocks.append(_WHITE.sub(" ", decoded("".join(now))).strip())
                now = []
        else:
            now.append(e)
    return "\n".join(x for x in blocks if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages; null html is empty and gives an empty text.

    Character references are decoded, white space in a block becomes one space, blocks are joined by a line feed. Null ids
    and urls stay null; repeated rows are read each; other columns are ignored; pages without markup are one block.
    """
    tuned(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in chunks(batches):
            texts = [extract(x.as_py() or "") for x in t["text"]]
            yield pa.RecordBatch.from_arrays([t["page_id"].combine_chunks(), t["url"].combine_chunks(), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("text"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
