"""Main text of web pages by tree scoring.

A page's markup becomes a tree of its block elements (inline elements only
matter for links and for what they hide). Parts that are never text (scripts,
forms, menus, footers, sidebars, adverts, notices, reader comments, hidden
elements) are marked by tag, role and the words of class and id; by words
alone only what, read to its end, doesn't look like the page's text. Every block
of text passes points for its length and commas to its ancestors, less with
each level; a title beside other text gives its container some more, and a container's
points are discounted by its link density. The best container (or the article
element around it) is kept with the siblings that score or read like it; beside
an article element these are what stands before it and articles with half of its
earned points. Boxes of links are menus, but not the lists within the best
container's prose.

Each page is read by itself in one Arrow pass: no shuffle, and memory is
bounded by a batch of pages.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ordertide.llm.tables import pick

#: Quoted values stop at "<", so that a stray quote costs no second scan of the page.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|"
                    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*'|[\"'])*)>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = set("script style noscript template iframe object canvas svg annotation annotation-xml title textarea select datalist audio video"
             .split())
#: Of these, what browsers read as raw text: without an end tag it takes the rest of the page.
RAW = set("script style title textarea iframe".split())
INLINE = set("a abbr acronym b bdi bdo big cite code del dfn em font i ins kbd mark q rp rt ruby s samp small span strike "
             "strong sub sup time tt u var nobr label data output math semantics mi mn mo ms mtext mrow mfrac msup msub msubsup msqrt "
             "mroot mover munder munderover mtable mtr mtd mstyle mspace mpadded mphantom menclose mfenced".split())
#: A new element with one of these tags ends an open one with any of the given tags.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"},
         "th": {"table", "tr"}, "tbody": {"table"}}
PARAGRAPH = set("p pre li blockquote h1 h2 h3 h4 h5 h6 dt dd td th figcaption caption address".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DROPPED = set("nav footer aside menu button dialog fieldset legend".split())
ARTICLE = {"article", "main"}
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar "
                    "toolbar tablist".split())
#: Words of class and id names.
DROPPED_NAMES = set("ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs nav navbar "
                    "navigation menu menus sidebar sidebars aside rail footer footers foot masthead topbar cookie cookies "
                    "consent gdpr notice notices alert popup modal overlay lightbox promo promos promotion sponsor sponsors "
                    "sponsored share sharing shares social related recommended recommendations newsletter subscribe "
                    "subscription signup login signin search pagination pager comment comments commentlist disqus reply "
                    "replies respond widget widgets toolbar skip tags outbrain taboola copyright form feedback".split())
#: Of these, words that text is named by, too: such an element is dropped only if it is short or full of links.
WEAK_NAMES = set("ad aside rail foot consent notice notices alert related recommended recommendations social sharing share "
                 "search subscription form feedback reply replies skip tags promotion navigation copyright header head hdr "
                 "widget banner".split())
COMMENT_NAMES = set("comment comments commentlist disqus reply replies respond".split())
WEAK_CHARS, WEAK_DENSITY = 140, 0.33
HEADER_NAMES = {"header", "head", "hdr"}
#: Like browsers: elements nested deeper than this are read into the one that holds them.
MAX_DEPTH = 512
GOOD_NAMES = set("article body content main post entry story text blog page hentry".split())
TAG_POINTS = {"article": 25, "main": 25, "div": 5, "section": 5, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3,
              "dl": -3, "form": -3, "li": -3, "dd": -3, "dt": -3, "address": -3, "th": -5, "table": -3}
NAME_POINTS = 25
#: For a container that holds its own title and other text beside it.
TITLE_POINTS = 12
LISTS = {"ul", "ol", "dl"}
MENU_TAGS = LISTS | set("div section table tr td".split())
COMMAS = re.compile("[,،、，;]")


class Node:
    __slots__ = ("tag", "parent", "dropped", "form", "names", "points", "earned", "chars", "links", "n_links", "at", "named")

    def __init__(self, tag, parent, dropped, form, names, at):
        self.tag, self.parent, self.dropped, self.form, self.names, self.at = tag, parent, dropped, form, names, at
        self.points, self.earned, self.chars, self.links, self.n_links, self.named = 0.0, 0.0, 0, 0, 0, set()

    def ancestors(self):
        n = self
        while n is not None:
            yield n
            n = n.parent


def _attributes(text: str) -> dict[str, str]:
    return {k.lower(): a or b or c or "" for k, a, b, c in ATTRIBUTE.findall(text)} if text.strip() else {}


def _names(attributes: dict[str, str]) -> set[str]:
    both = f"{attributes.get('class', '')} {attributes.get('id', '')}"
    return {w.lower() for w in NAME_WORDS.findall(both)} if len(both) > 1 else set()


def _is_dropped(tag: str, attributes: dict[str, str], names: set[str], in_article: bool) -> bool:
    if attributes:
        if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
            return True
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I):
            return True
        if tag not in ARTICLE and tag != "body" and attributes.get("role", "").lower() in DROPPED_ROLES:
            return True
    if tag == "aside" and in_article and names and not names & DROPPED_NAMES:
        return False  # a part of the article with a name of its own, such as a quotation
    return tag in DROPPED or tag == "header" and not in_article


def _drop_words(tag: str, attributes: dict[str, str], names: set[str], in_article: bool) -> set[str]:
    """The names' words that speak for dropping the element. Ids of headings
    and inline elements name places in the text."""
    if tag in ("html", "body", "main") or not names:
        return set()
    if (tag in HEADINGS or tag in INLINE) and "id" in attributes:
        names = _names({"class": attributes.get("class", "")})
    header = set() if in_article or names & GOOD_NAMES else names & HEADER_NAMES
    return names & DROPPED_NAMES | header


def _without_named(nodes: list[Node], found: list[tuple[Node, str, int, int]]) -> list[tuple[Node, str, int, int]]:
    """The blocks outside elements that their names drop."""
    if not any(n.named for n in nodes):
        return found
    for node, t, linked, _ in found:
        for a in node.ancestors():
            a.chars += len(t)
            a.links += linked
    own = [n for n in nodes if n.tag in ARTICLE and not n.dropped and not any(a.named & COMMENT_NAMES for a in n.ancestors())]
    holds = {id(a) for n in nodes if not n.dropped and (n.tag in ARTICLE or n.tag == "h1") and not n.named & COMMENT_NAMES
             for a in n.ancestors()}
    around = {id(a) for n in own for a in n.ancestors()}
    drop = set()
    for n in nodes:
        if not n.named:
            continue
        weak, good, density = not n.named - WEAK_NAMES, bool(n.names & GOOD_NAMES), _density(n)
        spared = (id(n) in holds if not n.named & COMMENT_NAMES else id(n) in around and n.tag not in ARTICLE)
        if weak and n.tag not in PARAGRAPH:
            spared = spared or density < WEAK_DENSITY and (good or n.chars >= WEAK_CHARS)
        if good and 2 * n.chars >= nodes[0].chars and density < 0.5:  # the page's text, if no article is elsewhere
            spared = spared or all(n in a.ancestors() for a in own)
        if not spared:
            drop.add(id(n))
    for n in nodes:
        n.chars = n.links = 0
    return [b for b in found if not any(id(a) in drop for a in b[0].ancestors())]


def blocks(page: str, by_name: bool = True) -> tuple[list[Node], list[tuple[Node, str, int, int]]]:
    """The tree's nodes in page order, and the blocks of text outside dropped
    parts: (element, text with single spaces, characters within links, links).
    ``by_name``: inline elements are dropped by their class, others get their
    ``named`` words."""
    root = Node("html", None, False, False, set(), 0)
    nodes, out, stack = [root], [], [root]
    parts: list[str] = []
    state = {"link": 0, "linked": 0, "n_links": 0}

    def text(raw: str) -> None:
        if raw and not stack[-1].dropped:
            t = html.unescape(raw) if "&" in raw else raw
            parts.append(t)
            if state["link"]:
                state["linked"] += len(" ".join(t.split()))

    def end_block() -> None:
        if parts:
            t = " ".join("".join(parts).split())
            if t:
                node = next(n for n in reversed(stack) if n.tag not in INLINE)
                out.append((node, t, min(len(t), state["linked"]), state["n_links"]))
            parts.clear()
        state["linked"] = state["n_links"] = 0

    def close(upto: int) -> None:
        end_block()
        del stack[upto:]

    at, unended = 0, set()
    for m in iter(lambda: MARKUP.search(page, at), None):
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        slash, tag, rest = m.group(1), (m.group(2) or "").lower(), m.group(3) or ""
        if not tag:
            if m.group().startswith("<![CDATA["):
                text(m.group()[9:].removesuffix("]]>"))
            continue
        if slash:
            if tag == "a":
                state["link"] = 0
            if tag == "br":
                text(" ")
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag in INLINE:
                        del stack[i:]
                    else:
                        close(i)
                    break
                if tag in INLINE and stack[i].tag not in INLINE:
                    break
            continue
        if tag in VOID:
            if tag == "hr":
                end_block()
            elif tag != "wbr":
                text(" ")
            continue
        if tag in UNREAD:
            if not rest.rstrip().endswith("/") and tag not in unended:
                found = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                close_at = page.find(">", found.start()) if found else -1
                if close_at >= 0:
                    at = close_at + 1
                elif tag in RAW:
                    at = len(page)
                else:  # no end tag on the page: it hides nothing
                    unended.add(tag)
            continue
        if tag == "body" or tag == "html":
            continue
        attributes = _attributes(rest)
        names = _names(attributes)
        if tag in INLINE:
            if tag == "a":
                state["link"] = 1
                state["n_links"] += 1
            if attributes and len(stack) < MAX_DEPTH and (
                    _is_dropped(tag, attributes, names, True)
                    or by_name and not names & GOOD_NAMES and _drop_words(tag, attributes, names, True)):
                stack.append(Node(tag, stack[-1], True, False, names, len(nodes)))
            continue
        end_block()
        for i in range(len(stack) - 1, 0, -1):  # implied ends
            open_tag = stack[i].tag
            if open_tag == "p" or open_tag in ENDS.get(tag, ()):
                close(i)
            elif open_tag in SCOPE.get(tag, ()) or open_tag not in INLINE and tag not in ENDS:
                break
        if len(stack) >= MAX_DEPTH:
            continue
        top = stack[-1]
        in_article = any(n.tag in ARTICLE for n in top.ancestors())
        node = Node(tag, top, top.dropped or _is_dropped(tag, attributes, names, in_article), top.form or tag == "form",
                    names, len(nodes))
        if by_name:
            node.named = _drop_words(tag, attributes, names, in_article)
        nodes.append(node)
        stack.append(node)
    if at < len(page):
        text(page[at:])
    end_block()
    return nodes, out


def _score(nodes: list[Node], found: list[tuple[Node, str, int, int]]) -> None:
    for n in nodes:
        n.points = TAG_POINTS.get(n.tag, 0) + NAME_POINTS * bool(n.names & GOOD_NAMES)
        if n.tag in HEADINGS:
            n.points -= 5
    for node, t, linked, n_links in found:
        points = (len(t) >= 25) + len(COMMAS.findall(t)) + min(len(t) / 100, 3)
        first = node.parent if node.tag in PARAGRAPH and node.parent is not None else node
        for level, a in enumerate(first.ancestors()):
            a.earned += points / (level + 1)
        for a in node.ancestors():
            a.chars += len(t)
            a.links += linked
            a.n_links += n_links
    beside = {id(node.parent) for node, *_ in found if node.tag not in HEADINGS}
    titled = {id(node.parent): node.parent for node, t, linked, _ in found if node.tag == "h1" and 2 * linked < len(t)}
    for n in nodes:
        n.points += n.earned + TITLE_POINTS * (id(n) in titled and id(n) in beside and n.parent is not None)


def _density(n: Node) -> float:
    return n.links / n.chars if n.chars else 0.0


def main_text(page: str | None) -> str:
    """The main text: kept blocks in page order, joined by one \\n."""
    if not page:
        return ""
    return _main_text(page, True) or _main_text(page, False)


def _main_text(page: str, by_name: bool) -> str:
    nodes, found = blocks(page, by_name)
    found = _without_named(nodes, found)
    # a form is dropped unless it holds the page's article or heading (pages that are one form)
    whole = {id(a) for n in nodes if n.tag in ARTICLE or n.tag == "h1" for a in n.ancestors() if a.tag == "form"}
    found = [b for b in found if not any(a.tag == "form" and id(a) not in whole for a in b[0].ancestors())]
    if not found:
        return ""
    _score(nodes, found)
    total = lambda n: n.points * (1 - _density(n))
    menus = [n for n in nodes if n.tag in MENU_TAGS and n.n_links >= (2 if n.tag in ("td", "tr") else 3) and _density(n) > 0.6]
    inside = lambda b, ids: any(id(a) in ids for a in b[0].ancestors())
    boxes = {id(n) for n in menus}
    text = [b for b in found if not inside(b, boxes)] or found
    candidates = {id(a): a for b in text for a in b[0].ancestors() if a.tag not in PARAGRAPH}
    best = max(candidates.values(), key=lambda n: (total(n), -n.at))
    # lists of links stay where the container's prose goes on behind them, or at the end of an article
    within = {id(best)}
    prose = [b[0].at for b in text if len(b[1]) >= 25 and inside(b, within)]
    ends = float("inf") if best.tag == "article" else max(prose, default=0)
    begins = min(prose, default=ends)
    boxes -= {id(n) for n in menus if n.tag in LISTS and begins < n.at < ends and inside((n,), within)}
    found = [b for b in found if not inside(b, boxes)] or found
    best = next((a for a in best.ancestors() if a.tag in ARTICLE), best)
    kept, limit = {id(best)}, max(10.0, 0.2 * total(best))
    for n in nodes:
        if n.parent is best.parent and n.parent is not None and n is not best and not n.dropped and n.chars:
            reads = n.tag == "p" and (n.chars > 80 and _density(n) < 0.25 or n.links == 0 and best.tag not in ARTICLE)
            like = n.tag not in PARAGRAPH and total(n) >= limit
            if best.tag in ARTICLE:
                like = like and n.tag in ARTICLE and n.earned * (1 - _density(n)) >= 0.5 * best.earned * (1 - _density(best))
                reads = reads and n.at < best.at
            if reads or like or n.tag in HEADINGS and n.at < best.at:
                kept.add(id(n))
    return "\n".join(b[1] for b in found if inside(b, kept))


def _extract(batches: Iterator[pa.RecordBatch]):
    for b in batches:
        ids, urls, pages = (b.column(b.schema.get_field_index(c)) for c in ("page_id", "url", "html"))
        texts = [main_text(p) for p in pages.to_pylist()]
        yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()),
                                          pa.array([len(t) for t in texts], pa.int64())],
                                         ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    Null and empty pages, and pages without text, give an empty text; broken,
    cut and very long markup is read as far as it goes. Repeated rows and null
    ids are kept, empty tables give empty results, other columns are not read."""
    d = pick(pages, page_id=id_col, url=url_col, html=html_col)
    types = dict(d.dtypes)
    return d.mapInArrow(_extract, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
