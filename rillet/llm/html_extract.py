"""HTML extraction by minimum-cut labelling.

A page becomes a list of text blocks in page order. A classifier prices both labels of each block from its own signs: containers it
stands in, their class names, link share, length, sentence signs. The prices are the capacities to the two terminals. Blocks that follow
each other are joined by smoothness edges, the stronger the nearer they are in the tree, and so are blocks of one parent across what stands
between them. The minimum cut, found by max-flow, labels all blocks at once. Prices and edges are of one size, so neighbours decide where a
block's own signs are weak: a one-word paragraph or a line of links between paragraphs is kept, the same between menus is not. A <main>
within what is named or marked as boilerplate is the main part all the same, and so is an <article> if the page marks no other; a form or a named
element that holds most of a page with no other article tells nothing. Work is per page with memory linear in the page; the plan is one scan with
Arrow batches and no shuffle.

Defined cases: null and empty pages give empty text; broken markup is read as browsers do in spirit (end tags close what is open under them, stray
ones are ignored, an unfinished tag ends at the next one or with the page), in time linear in the page; pages that repeat are extracted alike; columns
that clash with the added ones give way; what is hidden is no part of the page.
"""

from __future__ import annotations

import html
import re
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import load, make_room

#: Element names by their role.
UNSEEN = frozenset("head title script style noscript template iframe svg canvas object audio video map annotation annotation-xml select option textarea button".split())
RAW = frozenset("script style textarea title noscript iframe template xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
WALLS, OVER_WALLS = frozenset("td th table body".split()), frozenset("table tr tbody thead tfoot body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CHROME = frozenset("nav footer aside form menu dialog fieldset search".split())
FIXED = CHROME - {"form", "fieldset"} | {"header"}
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
ENDERS, SIGNED = frozenset().union(*ENDS.values()), CHROME | {"main", "article", "header"}
#: Whole names in class, id and role of what isn't the article, of what may be or not, and of what is.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo banner banners cookie cookies gdpr popup modal overlay toast newsletter subscribe subscription signup signin paywall "
    "nav navbar navigation menu menus submenu breadcrumb breadcrumbs pagination pager toc skip sidebar sidebars widget widgets aside complementary contentinfo footer foot header masthead topbar toolbar "
    "comment comments commentlist comment-list comments-area comments-section disqus share sharing share-buttons share-bar social-share social-links social-media related-posts related-articles related-stories more-stories recommended-posts taglist tag-list author-bio byline hidden print-only sr-only skip-link screen-reader-text".split()
) | {f"{a}-{b}" for a, bs in (
    ("cookie cookies consent gdpr privacy", "notice banner bar popup modal overlay consent policy"),
    ("ad ads advert advertisement google", "ad ads container slot banner unit wrapper box block"),
    ("entry post article site page main global top bottom left right primary secondary blog", "footer nav navigation menu navbar sidebar breadcrumb breadcrumbs share sharing comments ad ads"),
    ("newsletter subscribe subscription signup", "form box signup banner widget"),
    ("nav menu sidebar footer widget comment promo banner", "bar menu links list area inner wrapper container content widget item form box body left right"),
) for a in a.split() for b in bs.split()}
DOUBT_WORDS = frozenset("side rail promotion notice notices alert consent login register footnotes copyright legal respond reply replies discussion social follow related recommended recommendations trending popular tags search form".split())
MAIN_WORDS = frozenset("article articlebody article-body main main-content maincontent content post post-body post-content entry entry-content story story-body body-text text prose".split())
#: Parts of longer names that say the same as the whole ones, unless another part says that the element merely has such a thing.
CHROME_PARTS = frozenset("comment comments advert adverts advertisement advertisements ads sponsored cookie cookies gdpr newsletter".split())
NOTICE_PARTS = frozenset("notice notices".split())
HAVING_PARTS = frozenset("has no not with without open closed enabled disabled allow allowed page body layout site".split())
#: Comments, declarations, and tags with their attributes. Nothing is read twice: groups are possessive, and a tag ends at the next one at the latest.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:[\"'][^<>]*+)?(?:>|(?=<)|$)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]++))?""")
SENTENCE = re.compile(r"[.!?…。](?:\s|$)")
#: What short blocks outside a main part say that aren't the article: rights, and entries with bars between them.
RIGHTS, BARS = re.compile(r"(?i)©|\bcopyright\b|\ball rights reserved\b"), re.compile(r"\s[|·•»/]\s")
#: Smoothness of neighbours under one parent; half of it for one more step in the tree between them, none beyond FAR steps. BESIDE: of blocks of
#: one parent with others between them. Of each a quarter between blocks whose containers have different signs.
SMOOTH, FAR, BESIDE, CONTRAST = 1.0, 8, 0.5, 0.25
OPEN, MAIN, NOT_MAIN, UNSHOWN = 0, 1, 2, 3
#: Prices: of any block, of standing in and outside a main part, in boilerplate, of names, of links in and outside a main part, of rights and bars in blocks of
#: up to SHORT words.
ANY, IN_MAIN, OUTSIDE, IN_CHROME, CHROME_NAME, NOTICE_NAME, DOUBT_NAME, LINKS_IN_MAIN, LINKS, TOLD, SHORT = -1.0, 0.8, -3.5, -4.0, -6.0, -4.0, -0.8, -0.1, -4.0, -2.5, 25
#: Of what stands in an element: its role, the price of the names around it, whether an article within boilerplate holds it, and the element
#: whose signs say first that it is boilerplate.
Signs = tuple[int, float, bool, int]


class Block:
    __slots__ = ("parts", "linked", "role", "name", "inner", "by", "tag", "element")

    def __init__(self, signs: Signs, tag: str, element: int):
        self.parts, self.linked, self.tag, self.element = [], 0, tag, element
        self.role, self.name, self.inner, self.by = signs


def attributes(given: str) -> dict[str, str]:
    """Names and values, lower-cased; of repeated names the first."""
    out: dict[str, str] = {}
    for name, value in ATTRIBUTE.findall(given):
        out.setdefault(name.lower(), value.strip("\"'").lower())
    return out


def _signs(tag: str, given: str, around: Signs, number: int) -> Signs:
    """The signs of what stands in an element, from its own and those around it."""
    role, name, inner, by = around
    if role == UNSHOWN or tag in ("html", "body"):
        return around
    has = attributes(given) if given else {}
    if "hidden" in has or has.get("aria-hidden") == "true" or "display:none" in re.sub(r"\s", "", has.get("style", "")):
        return UNSHOWN, 0.0, False, number
    told = [(k, re.sub("[-_]+", "-", w)) for k in ("class", "id", "role", "itemprop") for w in has.get(k, "").split()]
    names = {w for _, w in told}
    if tag == "main" or ("role", "main") in told:
        return MAIN, 0.0, False, 0
    if tag in CHROME:
        return NOT_MAIN, name, inner, by or number
    if tag == "article" and (role == NOT_MAIN or name <= CHROME_NAME):
        return MAIN, 0.0, True, 0
    if role == NOT_MAIN:
        return around
    own = 0.0
    if not names & MAIN_WORDS:
        for kind, w in told:
            if kind == "id" and (tag in HEADINGS or role == MAIN and (tag == "section" or "section" in names)):  # an anchor, whatever the section is about
                own = min(own, DOUBT_NAME if w in CHROME_WORDS and tag not in HEADINGS else 0.0)
            elif w in CHROME_WORDS and not (role == MAIN and w in ("header", "masthead")):  # an article's own header holds its title
                own = min(own, CHROME_NAME)
            elif w in DOUBT_WORDS and not (w in NOTICE_PARTS and kind != "role"):
                own = min(own, DOUBT_NAME)
            elif not HAVING_PARTS & (parts := set(w.split("-"))):
                own = min(own, CHROME_NAME if parts & CHROME_PARTS else NOTICE_NAME if parts & NOTICE_PARTS else 0.0)
    if tag == "article" or names & MAIN_WORDS:
        role = MAIN
    elif tag == "header" and role != MAIN:
        role = NOT_MAIN
    return role, min(name, own), inner, by or (number if own <= CHROME_NAME or role == NOT_MAIN else 0)


def blocks(page: str, void: frozenset[int] = frozenset()) -> tuple[list[Block], list[int], list[str], bool]:
    """The page's text blocks, the parent and the tag of each element (elements are numbered in page order, 0 stands for the page), and whether it
    marks a main part. Elements of ``void`` give no signs."""
    out: list[Block] = []
    stack: list[tuple[str, Signs, int]] = []  # tag, signs around it, number
    opened: dict[str, list[int]] = {}  # places in the stack by tag
    walls: list[int] = []  # places of what only its own kind closes
    signs, parents, tags, links, unseen, at, marked = (OPEN, 0.0, False, 0), [0], [""], 0, 0, 0, False
    now = Block(signs, "", 0)

    def text(s: str) -> None:
        if unseen or not s:
            return
        now.parts.append(s)
        if links:
            now.linked += len(s)

    def cut(tag: str) -> Block:
        if any(not p.isspace() for p in now.parts):
            out.append(now)
        return Block(signs, tag, stack[-1][2] if stack else 0)

    def close(to: int) -> None:
        nonlocal signs, links, unseen, now
        seen_block = False
        while len(stack) > to:
            tag, signs_, _ = stack.pop()
            opened[tag].pop()
            if tag in WALLS:
                walls.pop()
            links -= tag == "a"
            unseen -= tag in UNSEEN
            seen_block |= tag in BLOCK
            signs = signs_
        if seen_block:
            now = cut(stack[-1][0] if stack else "")

    end = len(page)
    find = TOKEN.search
    while at < end and (m := find(page, at)):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if not (name := m[2]):
            continue
        tag = name.lower()
        if m[1]:
            if (places := opened.get(tag)) and (tag in OVER_WALLS or not walls or walls[-1] <= places[-1]):
                close(places[-1])
            continue
        if tag in VOID:
            if tag == "br":
                text(" ")
            elif tag == "hr":
                now = cut(tag)
            continue
        for i in range(len(stack) - 1, max(-1, len(stack) - 6), -1) if tag in ENDERS else ():
            if tag in ENDS.get(stack[i][0], ()):
                close(i)
                break
            if stack[i][0] in BLOCK and stack[i][0] not in ENDS:
                break
        attrs = m[3]
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        parents.append(stack[-1][2] if stack else 0)
        tags.append(tag)
        number = len(parents) - 1
        opened.setdefault(tag, []).append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        stack.append((tag, signs, number))
        if (tag in SIGNED or attrs and not attrs.isspace()) and number not in void:
            signs = _signs(tag, attrs, signs, number)
        marked |= signs[:3] == (MAIN, 0.0, False)
        links += tag == "a"
        unseen += tag in UNSEEN
        if tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            close(len(stack) - 1)
            at = stop.end() if stop else end
        elif tag in BLOCK:
            now = cut(tag)
    text(page[at:])
    cut("")
    return [b for b in out if b.role != UNSHOWN], parents, tags, marked


def price(b: Block, words: int, size: int, sentences: int, marked: bool, told: bool = False) -> float:
    """How much more the label boilerplate costs than the label article. ``told``: the text says by itself that it is none."""
    linked = b.linked / max(1, size)
    name = CHROME_NAME if b.inner and marked else b.name
    score = ANY + name + min(2.5, words / 12) + min(1.5, 0.75 * sentences) + (0.5 if b.tag in HEADINGS else 0.0)
    if b.role == NOT_MAIN:
        return IN_CHROME + name + min(1.0, words / 50)
    if b.role == MAIN:
        return score + IN_MAIN + (LINKS if name <= CHROME_NAME else LINKS_IN_MAIN) * linked
    return score + (OUTSIDE if marked else 0.0) + LINKS * linked + TOLD * told


def distance(a: int, b: int, parents: list[int]) -> int:
    """Steps in the tree from one element to another, or FAR + 1."""
    steps = 0
    while a != b and steps <= FAR:  # numbers ascend from parents to children
        a, b = (parents[a], b) if a > b else (a, parents[b])
        steps += 1
    return steps


def edges(found: list[Block], parents: list[int], tags: list[str] | None = None) -> list[tuple[int, int, float]]:
    # An item stands where its list does: the list itself is no step away from what surrounds it.
    lists = ("ul", "ol", "dl")
    place = lambda b: parents[b.element] if tags and tags[b.element] in ("li", "dt", "dd") and tags[parents[b.element]] in lists else b.element
    alike = lambda a, b: 1.0 if (a.role, a.name) == (b.role, b.name) else CONTRAST
    out, last = [], {}
    for i, b in enumerate(found):
        if i and (d := max(2, distance(place(found[i - 1]), place(b), parents)) if place(found[i - 1]) != place(b) else distance(found[i - 1].element, b.element, parents)) <= FAR:
            out.append((i - 1, i, SMOOTH * 2.0 ** (2 - d) * alike(found[i - 1], b)))
        beside = parents[b.element]
        if last.get(beside, i - 1) != i - 1:
            out.append((last[beside], i, BESIDE * alike(found[last[beside]], b)))
        last[beside] = i
    return out


def cut_labels(prices: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for article: the labels of the least sum of prices of the other label and of cut edges (ties: article)."""
    n = len(prices)
    to: list[list[int]] = [[] for _ in range(n + 2)]
    head: list[int] = []
    room: list[float] = []

    def edge(u: int, v: int, there: float, back: float) -> None:
        to[u].append(len(head))
        head.append(v)
        room.append(there)
        to[v].append(len(head))
        head.append(u)
        room.append(back)

    s, t = n, n + 1
    for i, p in enumerate(prices):
        edge(s, i, p, 0.0) if p > 0 else edge(i, t, -p, 0.0)
    for u, v, w in edges:
        edge(u, v, w, w)
    while True:  # level graphs, then blocking flows along them
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in to[u]:
                if room[e] > 1e-9 and level[head[e]] < 0:
                    level[head[e]] = level[u] + 1
                    queue.append(head[e])
        if level[t] < 0:
            break
        tried = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                least = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least
                    room[e ^ 1] += least
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                u = head[path[k] ^ 1]
                del path[k:]
                continue
            while tried[u] < len(to[u]):
                e = to[u][tried[u]]
                if room[e] > 1e-9 and level[head[e]] == level[u] + 1:
                    break
                tried[u] += 1
            if tried[u] < len(to[u]):
                path.append(e)
                u = head[e]
            elif path:
                e = path.pop()
                u = head[e ^ 1]
                tried[u] += 1
            else:
                break
    # What can still reach the sink is boilerplate.
    drains = [False] * (n + 2)
    drains[t] = True
    queue = deque([t])
    while queue:
        v = queue.popleft()
        for e in to[v]:
            if room[e ^ 1] > 1e-9 and not drains[head[e]]:
                drains[head[e]] = True
                queue.append(head[e])
    return [not d for d in drains[:n]]


def priced(page: str) -> tuple[list[str], list[float], list[tuple[int, int, float]]]:
    """Texts, prices and edges of a page's blocks."""
    void: frozenset[int] = frozenset()
    while True:
        found, parents, tags, marked = blocks(page, void)
        texts = [" ".join(html.unescape("".join(b.parts)).split()) for b in found]
        found, texts = [b for b, t in zip(found, texts) if t], [t for t in texts if t]
        words = [t.count(" ") + 1 for t in texts]
        prices = [price(b, n, len(t), k := len(SENTENCE.findall(t)), marked, n <= SHORT and (RIGHTS.search(t) is not None or not k and len(BARS.findall(t)) > 1)) for b, t, n in zip(found, texts, words)]
        if not found or max(prices) > 0 or len(void) == 3:
            break
        # A form, or what has a name, tells nothing if it holds most of a page that has no other article.
        by: dict[int, int] = {}
        for b, n in zip(found, words):
            if b.by and tags[b.by] not in FIXED:
                by[b.by] = by.get(b.by, 0) + n
        most = max(by, key=by.get, default=0)
        if not most or 2 * by[most] < sum(words):
            break
        void |= {most}
    near = edges(found, parents, tags)
    if not void and not any(cut_labels(prices, near)):  # texts that are all short: length and sentences tell nothing, containers and links do
        prices = [1.0 if b.role != NOT_MAIN and b.name > NOTICE_NAME and 2 * b.linked < len(t) else IN_CHROME for b, t in zip(found, texts)]
    return texts, prices, near


def extract(page: str | None) -> str:
    """The main text of a page."""
    texts, prices, near = priced(page or "")
    return " ".join(t for t, keep in zip(texts, cut_labels(prices, near)) if keep)


def extract_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """``pages`` with text (string) and n_chars (long: code points)."""
    pages = make_room(pages, *[c for c in ("text", "n_chars") if c != column])

    @F.arrow_udf(T.StringType())
    def texts(given: pa.Array) -> pa.Array:
        return pa.array((extract(x.as_py()) for x in given), pa.string())

    return pages.withColumn("text", texts(F.col(column))).withColumn("n_chars", F.char_length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: all pages."""
    return extract_text(load(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
