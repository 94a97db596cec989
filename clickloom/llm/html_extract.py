"""Main text of web pages by consensus host paths.

Each page's containers are scored by the running text that they hold, the scores become votes for generalised
tag-class paths, Spark adds the votes per host, and every page is read again at its host's winning path. A page
without that path, or of no host, falls back to its own best container.

What is no part of the article is voted on: an element's tag, role, class and id, the links it holds, where it stands and
whether the host shows such an element at that place on many pages each speak, and it goes when two votes agree. A name
speaks by its last word that is not mere layout, as the head of a compound (a page-footer is a footer, side-effects are
effects); an id that repeats its section's heading, ids of text elements and names of inline elements say nothing. What
stands at one path with one text on page after page is the site's. A path is the hash of its parent's path and its own
step, so deep pages cost no more than long ones.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_long, attach, materialise, slices

_TAG = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)"
    r"|<(script|style|noscript|template|textarea|title|iframe|svg|select|object|xmp|noembed)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>(?:.*?</\1\s*>|.*\Z)"
    r"|<(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?/][^>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_SPACE = re.compile(r"\s+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var img wbr".split()
)
_CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header"
    " hr main menu nav ol p pre section table ul".split()
)
#: A start tag that ends an open one of these, up to the given ancestors.
_ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Never part of an article, whatever they hold.
_GONE = frozenset("button dialog menu datalist video audio canvas map input".split())
#: Part of the frame, unless they hold the article itself.
_FRAME = frozenset("nav footer aside form fieldset".split())
_CONTAINERS = frozenset("body article main section div td blockquote center form".split())
_FRAME_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form".split())
_TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption td th tr tbody li dd dt".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_CONTENT_NAMES = frozenset("article content main entry post story body text".split())
# Words of class and id names. Those of advertising and the frame speak on any block, the others not on text.
_FRAME_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsbygoogle adslot adunit sponsor sponsors sponsored"
    " nav navbar navigation topnav sidenav subnav menu menus breadcrumb breadcrumbs sidebar footer masthead rail promo promos promoted promotion"
    " cookie cookies consent gdpr comment comments commentlist disqus newsletter subscribe subscription pagination pager popup modal".split()
)
_BLOCK_NAMES = _FRAME_NAMES | frozenset(
    "side aside foot topbar toolbar banner notice notices alert alerts overlay respond response responses reply replies discussion discussions review reviews"
    " share sharing social related recommended recommendations signup login search hidden more bio widget widgets disclaimer paywall tags teaser teasers".split()
)
# Layout words that may stand behind the word that counts, or be joined with it.
_LAYOUT = frozenset(
    "content body text box block wrapper wrap container list item items section area inner outer main site page post entry story article panel module row col column"
    " group unit holder left right top bottom wide small large bar link links title header head form slot zone card cards count".split()
)
_JOINED = {a + b for a in ("ad", "ads", "promo", "nav", "menu", "comment", "comments", "reply", "share", "sponsor", "widget", "review", "footer", "sidebar", "banner", "cookie") for b in ("box", "bar", "list", "block", "wrap", "wrapper", "area", "links", "form", "slot", "unit", "panel", "text", "item")}
_ENDINGS = ("footer", "sidebar", "navbar", "comments", "cookie", "advert", "newsletter", "breadcrumbs")
#: A word after one of the first, or before one of the second, describes a page's layout or state.
_BEFORE, _AFTER = frozenset("has with no without is show hide".split()), frozenset("open opened closed on off enabled disabled".split())
_HUMP, _WORDS, _DIGITS = re.compile(r"([a-z0-9])([A-Z])"), re.compile(r"[a-z]+"), re.compile(r"\d+")


def _words(name: str) -> list[str]:
    return _WORDS.findall(_HUMP.sub(r"\1-\2", name).lower())


def _heads(value: str) -> set[str]:
    """The words of class and id names that tell what an element is: the last of each name that is not mere layout.

    A word that tells a state, as in has-sidebar or comments-open, tells nothing.
    """
    out = set()
    for name in value.split():
        words = _words(name)
        while len(words) > 1 and words[-1] in _LAYOUT:
            words.pop()
        if words and not (len(words) > 1 and words[-2] in _BEFORE) and not (words[-1] in _AFTER and len(words) > 1):
            out.add(words[-1])
    return out


def _named(heads: set[str], names: frozenset[str]) -> bool:
    return not heads.isdisjoint(names) or not heads.isdisjoint(_JOINED) or any(w.endswith(_ENDINGS) for w in heads)


class _Node:
    __slots__ = ("tag", "step", "key", "depth", "gone", "votes", "by_id", "inside", "links", "up", "own", "mass", "size", "linked", "n_links", "anchor", "content", "controls", "last", "heading", "dropped")

    def __init__(self, tag: str, step: str, key: int, depth: int, gone: bool, links: bool, up: int) -> None:
        self.tag, self.step, self.key, self.depth, self.gone, self.links, self.up = tag, step, key, depth, gone, links, up
        self.own = self.mass = 0.0
        self.size = self.linked = self.n_links = self.votes = 0
        self.last = -1
        self.by_id = self.heading = ""
        self.inside = self.anchor = self.content = self.controls = self.dropped = False


def _look(tag: str, attributes: str) -> tuple[str, bool, bool, str, str]:
    """An element's step (digits in classes become #), whether it is hidden, whether its role is the frame's, its classes and id."""
    classes, hidden, role, own, named = "", False, False, "", ""
    if attributes and not attributes.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "class":
                classes = ".".join(sorted(set(_DIGITS.sub("#", value).split())))
                own = value
            elif name == "id":
                named = value
            elif name == "role":
                role = role or value.strip().lower() in _FRAME_ROLES
            elif name == "hidden":
                hidden = True
            elif name == "style":
                plain = value.replace(" ", "").lower()
                hidden = hidden or "display:none" in plain or "visibility:hidden" in plain
    return (f"{tag}.{classes}" if classes else tag), hidden and tag not in ("body", "html"), role, own, named


def read_page(html: str) -> tuple[list[_Node], list[tuple[int, str, bool]]]:
    """Elements in document order and text blocks as (innermost block element's number, text, heading), frame included."""
    nodes = [_Node("#", "", 0, 0, False, False, -1)]
    stack, open_tags = [0], Counter()
    blocks: list[tuple[int, str, bool]] = []
    piece: list[str] = []
    linked = n_links = holder = 0

    def end_block() -> None:
        nonlocal piece, linked, n_links
        if piece:
            text = _SPACE.sub(" ", "".join(piece)).strip()
            if text:
                nodes[holder].last = len(blocks)
                blocks.append((holder, text, nodes[holder].tag in _HEADINGS))
                node, n = nodes[holder], len(text)
                plain = max(0, n - linked)
                node.own += plain * plain / n
                node.size, node.linked, node.n_links = node.size + n, node.linked + min(n, linked), node.n_links + n_links
            piece, linked, n_links = [], 0, 0

    def pop_to(depth: int) -> None:
        nonlocal holder
        for i in stack[depth:]:
            open_tags[nodes[i].tag] -= 1
        del stack[depth:]
        for i in reversed(stack):  # inline elements hold no blocks
            if nodes[i].tag not in _INLINE:
                holder = i
                break

    def add(raw: str) -> None:
        nonlocal linked
        top = nodes[stack[-1]]
        if not top.gone:
            text = unescape(raw) if "&" in raw else raw
            piece.append(text)
            if top.links:
                linked += len(text)

    at = 0
    for m in _TAG.finditer(html):
        if m.start() > at:
            add(html[at : m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            if m[1] and m[1].lower() in ("iframe", "object", "textarea", "select"):
                end_block()
            continue
        tag = tag.lower()
        if m[2]:
            if not open_tags[tag]:
                continue
            for depth in range(len(stack) - 1, 0, -1):
                if nodes[stack[depth]].tag == tag:
                    if tag not in _INLINE:
                        end_block()
                    pop_to(depth)
                    break
                if tag in _INLINE and nodes[stack[depth]].tag not in _INLINE:
                    break  # an inline end tag closes no block
            continue
        if tag in _VOID:
            if tag == "br":
                add(" ")
            elif tag == "hr":
                end_block()
            elif tag == "input":
                nodes[holder].controls = True
            continue
        inline = tag in _INLINE
        if not inline:
            end_block()
            closing, scope = _ENDS.get(tag, ((), ()))
            if tag in _CLOSES_P:
                closing, scope = (*closing, "p"), (*scope, "article", "td", "li", "button")
            if any(open_tags[t] for t in closing):
                for depth in range(len(stack) - 1, 0, -1):
                    name = nodes[stack[depth]].tag
                    if name in closing:
                        pop_to(depth)
                        break
                    if name in scope or (tag in _CLOSES_P and tag not in _ENDS and name not in _INLINE):
                        break
            if tag in ("html", "body") and open_tags[tag]:
                continue
        up = stack[-1]
        parent = nodes[up]
        if m[4].rstrip().endswith("/") and tag not in _CONTAINERS:
            continue
        step, hidden, role, classes, named = _look(tag, m[4])
        plain = inline or tag in ("html", "p")
        key = parent.key if plain else xxhash.xxh64_intdigest(step, parent.key) >> 1
        node = _Node(tag, step, key, parent.depth + (not plain), parent.gone or hidden or tag in _GONE, parent.links or tag == "a", up)
        node.inside = parent.inside or tag in ("article", "main")
        if tag == "a":
            n_links += 1
        elif tag == "button":
            nodes[holder].controls = True
        if not inline:
            words = {w for x in (classes, named) for w in _words(x)} if classes or named else set()
            node.content = not words.isdisjoint(_CONTENT_NAMES)
            if role or tag in ("nav", "footer", "form"):
                node.votes = 2
            elif tag in _FRAME:
                node.votes = 1 if parent.inside else 2
            if tag not in ("html", "body", "main"):
                text = tag in _TEXT_TAGS or tag == "article"
                names = _FRAME_NAMES if text else _BLOCK_NAMES
                if classes and _named(_heads(classes), names):
                    node.votes = 2
                if named and not text and _named(_heads(named), names):
                    node.by_id = " ".join(_words(named))  # counts unless it only repeats the heading
            if (tag == "header" or not words.isdisjoint(("header", "head"))) and tag not in _TEXT_TAGS and not (parent.inside or node.content):
                node.votes = 2  # an article's own header holds its title
            node.anchor = tag in ("h1", "main") or (tag == "article" and node.votes < 2)
            holder = len(nodes)
        open_tags[tag] += 1
        nodes.append(node)
        stack.append(len(nodes) - 1)
    if at < len(html):
        add(html[at:])
    end_block()
    for i, text, heading in blocks:
        while heading and i >= 0 and not nodes[i].heading:
            nodes[i].heading, i = text, nodes[i].up
    _count(nodes)
    return nodes, blocks


def _count(nodes: list[_Node]) -> None:
    """Sums over what each element holds, and the votes that hang on them."""
    for n in nodes:
        n.mass = n.own
    for n in reversed(nodes[1:]):
        up = nodes[n.up]
        up.mass, up.size, up.linked, up.n_links, up.anchor = up.mass + n.mass, up.size + n.size, up.linked + n.linked, up.n_links + n.n_links, up.anchor or n.anchor
        up.last, up.controls = max(up.last, n.last), up.controls or n.controls
    for n in nodes[1:]:
        if n.by_id and n.by_id != " ".join(_words(n.heading)):
            # a section's id may come from a heading that is worded otherwise: it counts whole only at its parent's end
            n.votes += 1 if n.tag == "section" and n.last < nodes[n.up].last else 2
        if n.votes == 1 and (n.controls or 2 * n.linked >= n.size > 0):
            n.votes = 2
        if n.tag in ("ul", "ol") and n.n_links >= 3 and n.linked >= 0.9 * n.size:
            n.votes += 2 if n.linked < 20 * n.n_links else 1  # names of places to go; longer ones may be cited titles


def judge(nodes: list[_Node], often: frozenset[int] = frozenset()) -> None:
    """Which elements go: those with two votes, ``often`` (their place is seen on many pages of the host) being one.

    An element that holds the heading or article and most of the text stays.
    """
    half = nodes[0].mass / 2
    for n in nodes[1:]:
        out = n.votes + (n.votes > 0 and n.key in often) >= 2
        n.dropped = nodes[n.up].dropped or n.gone or (out and not (n.anchor and n.mass >= half))


def doubtful(nodes: list[_Node]) -> set[int]:
    """Paths of elements with one vote, for the host to decide on."""
    return {n.key for n in nodes if n.votes == 1 and not n.gone}


def _kept(nodes: list[_Node], blocks: list[tuple[int, str, bool]]) -> list[tuple[int, str, bool]]:
    return [b for b in blocks if not nodes[b[0]].dropped]


def score_containers(nodes: list[_Node], blocks: list[tuple[int, str, bool]]) -> dict[int, float]:
    """Score of each container with kept text: its unlinked text, 0.7 of that for each container that lies between.

    ``article`` and ``main`` count twice, a container named like content half as much again.
    """
    held = [0.0] * len(nodes)
    for i in {i for i, _, _ in blocks}:
        held[i] = nodes[i].own
    for i in range(len(nodes) - 1, 0, -1):
        if held[i]:
            held[nodes[i].up] += held[i] * (0.7 if nodes[i].tag in _CONTAINERS else 1.0)
    return {
        i: held[i] * (2.0 if n.tag in ("article", "main") else 1.5 if n.content else 1.0)
        for i, n in enumerate(nodes)
        if held[i] and (i == 0 or n.tag in _CONTAINERS)
    }


def _best(scores: dict[int, float]) -> int:
    return max(scores, key=lambda c: (scores[c], -c), default=0)


def _label(nodes: list[_Node], i: int, most: int = 12) -> str:
    """The last steps of a path, for people."""
    steps = []
    while i > 0 and len(steps) < most:
        steps.append(nodes[i].step)
        i = nodes[i].up
    return ("" if i > 0 else "/") + "/".join(reversed(steps))


def _digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) >> 1


def path_texts(nodes: list[_Node], blocks: list[tuple[int, str, bool]], most_share: float = 0.2) -> dict[int, int]:
    """path -> digest of all texts at it, for paths of plain blocks that hold a small share of the page's text."""
    texts: dict[int, list[str]] = {}
    for i, text, heading in blocks:
        if not heading:
            texts.setdefault(nodes[i].key, []).append(text)
    total = sum(len(t) for _, t, _ in blocks)
    return {k: _digest("\n".join(x)) for k, x in texts.items() if sum(map(len, x)) <= most_share * total}


def page_votes(html: str, least: float = 0.1) -> tuple[list[tuple[int, int, str, float]], dict[int, int], int, set[int]]:
    """(path, depth, label, share of the best score) for containers of ``least`` of it, texts by path, the page's digest,
    and the paths of elements that one vote speaks against."""
    nodes, blocks = read_page(html)
    judge(nodes)
    blocks = _kept(nodes, blocks)
    scores = score_containers(nodes, blocks)
    most = max(scores.values(), default=0.0)
    votes: dict[int, tuple[int, int, str, float]] = {}
    for c, score in scores.items():
        if score >= least * most > 0:
            known = votes.get(nodes[c].key)
            if known is None or known[3] < score / most:
                votes[nodes[c].key] = (nodes[c].key, nodes[c].depth, _label(nodes, c), score / most)
    return list(votes.values()), path_texts(nodes, blocks), _digest("\n".join(t for _, t, _ in blocks)), doubtful(nodes)


def page_text(html: str, path: int | None, site: frozenset[int] = frozenset(), often: frozenset[int] = frozenset(), most_more: float = 0.25) -> str:
    """Text at ``path``, or at the page's own best container where it has no text there.

    A title that stands before it belongs to it, if the element that holds both has at most ``most_more`` more text.
    ``site``: paths of the site's texts; ``often``: paths of doubtful elements that many pages have.
    """
    nodes, blocks = read_page(html)
    judge(nodes, often)
    blocks = _kept(nodes, blocks)
    if site:
        small = path_texts(nodes, blocks)
        blocks = [b for b in blocks if b[2] or nodes[b[0]].key not in site or nodes[b[0]].key not in small]
    if not blocks:
        return ""

    def under(wanted) -> list[int]:
        inside = [False] * len(nodes)
        for i, n in enumerate(nodes):
            inside[i] = (n.up >= 0 and inside[n.up]) or wanted(i, n)
        return [k for k, (i, _, _) in enumerate(blocks) if inside[i]]

    found = under(lambda i, n: n.key == path and (i == 0 or n.tag in _CONTAINERS)) if path is not None else []
    if not found:
        best = _best(score_containers(nodes, blocks))
        found = under(lambda i, n: i == best)
    titled = _with_title(nodes, blocks, found[0])
    if titled is not None:
        more = under(lambda i, n: i == titled)
        size = lambda ks: sum(len(blocks[k][1]) for k in ks if nodes[blocks[k][0]].tag != "h1")
        if set(found) <= set(more) and size(more) <= (1 + most_more) * size(found):
            found = more
    return "\n\n".join(blocks[k][1] for k in found)


def _with_title(nodes: list[_Node], blocks: list[tuple[int, str, bool]], first: int) -> int | None:
    """The innermost element that holds the page's one h1, which stands before the first block found, and that block."""
    titles = [k for k, (i, _, _) in enumerate(blocks) if nodes[i].tag == "h1"]
    if len(titles) != 1 or titles[0] >= first:
        return None
    above, i = set(), blocks[titles[0]][0]
    while i >= 0:
        above.add(i)
        i = nodes[i].up
    i = blocks[first][0]
    while i not in above:
        i = nodes[i].up
    return i


_VOTES = T.StructType(
    [
        T.StructField("host", T.StringType()), T.StructField("path", T.LongType()), T.StructField("depth", T.LongType()), T.StructField("label", T.StringType()),
        T.StructField("votes", T.DoubleType()), T.StructField("pages", T.LongType()), T.StructField("text_min", T.LongType()), T.StructField("text_max", T.LongType()),
        T.StructField("page_min", T.LongType()), T.StructField("page_max", T.LongType()), T.StructField("doubts", T.LongType()), T.StructField("reads", T.LongType()),
    ]
)
_VOTE_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.float64(), *[pa.int64()] * 7]
#: The path under which a host's pages are counted; hashes of paths are never negative.
_PAGES = -1


def host_of(url: str = "url"):
    """Lower-case host of a url, null where there is none."""
    host = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        sums: dict[tuple[str, int], list] = {}  # pre-aggregated by batch: a hot host sends few rows
        for batch in slices(whole):
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                votes, texts, page, doubts = page_votes(html)
                entry = lambda path: sums.setdefault((host, path), [0, None, 0.0, 0, None, None, None, None, 0, 0])  # noqa: B023, E731
                entry(_PAGES)[9] += 1
                for path, depth, label, vote in votes:
                    e = entry(path)
                    e[0], e[1], e[2] = depth, label, e[2] + vote
                for path, text in texts.items():
                    e = entry(path)
                    e[3:8] = (1, text, text, page, page) if not e[3] else (e[3] + 1, min(e[4], text), max(e[5], text), min(e[6], page), max(e[7], page))
                for path in doubts:
                    entry(path)[8] += 1
        rows = [(h, p, *e) for (h, p), e in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 12, _VOTE_TYPES)], names=_VOTES.names)


def winning_paths(pages: DataFrame, least_pages: int = 4) -> tuple[DataFrame, DataFrame]:
    """(host, path, label): the path with most votes of each host, and (host, key, often): places that pages leave out.

    Ties go to the shallower, then the lesser path. ``often`` false: a path whose texts are the site's, as ``least_pages``
    pages or more have it, all with one text, and these pages are not all alike. ``often`` true: a path at which
    ``least_pages`` pages or more and half of the host's have an element that one vote speaks against.
    """
    rows = pages.select(host_of().alias("host"), "html").where("host is not null and html is not null and html <> ''")
    sums = rows.mapInArrow(_vote, _VOTES).groupBy("host", "path").agg(
        F.max("depth").alias("depth"), F.max("label").alias("label"), F.round(F.sum("votes"), 6).alias("votes"), F.sum("pages").alias("pages"), F.sum("doubts").alias("doubts"), F.sum("reads").alias("reads"),
        *(F.expr(f"{x[-3:]}({x})").alias(x) for x in ("text_min", "text_max", "page_min", "page_max")),
    )
    sums = materialise(sums, "path-votes")
    order = F.struct((-F.col("votes")).alias("v"), "depth", "path")
    best = F.min_by(F.when(F.col("votes") > 0, F.struct("path", "label")), order)
    winners = sums.groupBy("host").agg(best.alias("best")).select("host", "best.path", "best.label")
    own = (F.col("pages") >= least_pages) & (F.col("text_min") == F.col("text_max")) & (F.col("page_min") < F.col("page_max"))
    counted = sums.where(F.col("path") == _PAGES).select("host", F.col("reads").alias("all"))
    found = sums.where(own | (F.col("doubts") >= least_pages)).join(counted, "host")
    often = (F.col("doubts") >= least_pages) & (2 * F.col("doubts") >= F.col("all"))
    return winners, found.select("host", F.col("path").alias("key"), F.explode(F.array_compact(F.array(F.when(own, F.lit(False)), F.when(often, F.lit(True))))).alias("often"))


_TEXT = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("path", T.StringType())]
)


def _extract(places: dict[str, tuple[frozenset[int], frozenset[int]]] | None):
    none: tuple[frozenset[int], frozenset[int]] = (frozenset(), frozenset())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text=2):
                texts = []
                for host, html, path, site, often in zip(*(batch.column(i).to_pylist() for i in (5, 2, 3, 6, 7))):
                    own = (frozenset(site or ()), frozenset(often or ())) if places is None else places.get(host, none)
                    texts.append(page_text(html, path, *own) if html else "")
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(4)], names=_TEXT.names)

    return scan


def extract(pages: DataFrame, most_places: int = 200_000) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars, and the host's winning path (its last steps).

    Null and empty pages, and pages of boilerplate alone, have an empty text. Pages of a null or hostless url take
    their own best container. Repeated rows give a row each; extra columns are not read; an empty table gives none.
    Hosts are far fewer than pages: their winning paths are broadcast below a checked size and joined by shuffle beyond it.
    The places that pages leave out are looked up by host in a table that goes to the tasks once, below ``most_places``
    of them; beyond, only hosts that have such places get them joined.
    """
    rows = pages.select(as_long("page_id"), "url", "html", host_of().alias("host"))
    winners, places = winning_paths(pages)
    placed = attach(rows, winners, ["host"], "paths", row_bytes=F.octet_length("host") + F.coalesce(F.octet_length("label"), F.lit(0)) + 80)
    places = materialise(places, "places")
    columns = ["page_id", "url", "html", "path", "label", "host"]
    if places.count() <= most_places:
        known: dict[str, tuple[set[int], set[int]]] = {}
        for r in places.collect():  # bounded by the count
            known.setdefault(r["host"], (set(), set()))[r["often"]].add(r["key"])
        none = F.lit(None).cast("array<long>")
        ready, table = placed.select(*columns, none.alias("site"), none.alias("often")), {h: (frozenset(a), frozenset(b)) for h, (a, b) in known.items()}
    else:
        of = lambda often: F.collect_set(F.when(F.col("often") == F.lit(often), F.col("key")))
        ready, table = placed.join(places.groupBy("host").agg(of(False).alias("site"), of(True).alias("often")), "host", "left").select(*columns, "site", "often"), None
    out = ready.mapInArrow(_extract(table), _TEXT)
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "path")
