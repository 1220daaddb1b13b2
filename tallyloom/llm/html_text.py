"""Main text of web pages by consensus of their host.

Every page votes for the container that scores best: the one whose paragraphs hold most text
outside links. A container is named by its generalised path, the tags and classes down to it
with digits left out, so that pages of one template name the same one. Votes are counted per
host by Spark; the leading paths of a host win. A second reading takes the text of the
winning containers, also on pages where something else scored better.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import durable, small_batches

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)/?>", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)")

# Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr img".split())
UNWANTED = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input iframe object "
    "applet svg canvas audio video map menu dialog datalist noembed noframes title".split())
UNWANTED_ROLES = frozenset(
    "navigation banner contentinfo complementary search form menu menubar toolbar dialog alertdialog alert tooltip status".split())
#: Words in a class or id that tell what is around an article, with beginnings of some.
AROUND = re.compile(
    r"(?:nav|navbar|navigation|menu|submenu|breadcrumbs?|crumbs|sidebar|sidenav|aside|footer|foot|header|masthead|topbar|"
    r"ads?|adv|advert\w*|adsense|adbox|adslot|sponsor\w*|promo\w*|banner|cookies?|cookiebar|consent|gdpr|notices?|notification|"
    r"alert|popup|modal|overlay|lightbox|newsletter|subscribe|subscription|signup|signin|login|register|share|sharing|sharebar|"
    r"social|related|recommend\w*|trending|popular|comments?|commentlist|replies|reply|respond|disqus|discussion|"
    r"pagination|pager|pagenav|widgets?|toolbar|search|searchbox|searchform|copyright|legal|disclaimer|skip|skiplink|form|"
    r"hidden|sr)")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
TELLING = re.compile(r"class|id|role|style|hidden", re.I)
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
#: Words before one of these that turn its meaning: a page with a sidebar is not the sidebar.
TURNING = frozenset("has with no without".split())
#: Words that make a header that of the article.
OWN_HEADER = frozenset("article post entry story content".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul".split())
#: What an element ends that is still open, and what keeps it from doing so.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
        "option": ({"option"}, {"select"}), "thead": ({"tbody"}, {"table"}), "tbody": ({"thead", "tbody"}, {"table"}),
        "tfoot": ({"tbody"}, {"table"}), "body": ({"head"}, set())}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p pre blockquote li dd td th figcaption".split()) | HEADINGS
ARTICLES = ("article", "main")
#: Elements that hold parts of one thing and are no containers themselves.
PARTS = frozenset("tr tbody thead tfoot ul ol dl".split())
LISTS = frozenset("ul ol div section table dl p".split())


@lru_cache(4096)
def hash_path(above: int, name: str) -> int:
    """64-bit hash of a path from that of the path above and one more name."""
    return xxhash.xxh3_64_intdigest(name.encode(), above & (1 << 64) - 1) - (1 << 63)


@dataclass
class Node:
    """An element that is no inline one: its generalised path as a hash, and whether it is left out."""

    tag: str
    parent: Node | None
    name: str
    path: int
    depth: int
    gone: bool = False
    named: bool = False  # as something around the article
    main: bool = False  # holds a main element, or an article with its title
    within: bool = False  # lies in an article or main element
    head: bool = False  # lies in a header
    text: int = 0  # characters of all text in it that stays
    linked: int = 0  # of these, in links
    links: int = 0
    score: float = 0.0
    blocks: list[int] = field(default_factory=list)  # first and last block


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        name = (m[1] or m[5]).lower()
        found.setdefault(name, html.unescape(m[2] or m[3] or m[4] or ""))
    return found


def _around(names: str) -> bool:
    """Whether class or id names tell of menus, adverts, comments and the like."""
    for name in names.split():
        words = [w.lower() for w in WORD.findall(name)]
        for i, word in enumerate(words):
            before = words[i - 1] if i else ""
            if AROUND.fullmatch(word) and before not in TURNING and not (word == "header" and before in OWN_HEADER):
                return True
    return False


@lru_cache(4096)
def _judged(tag: str, written: str) -> tuple[str, bool, bool]:
    """(tag and classes without digits in alphabetical order, to be left out, named as something around)."""
    found = _attributes(written)
    classes = found.get("class", "")
    unwanted = (
        tag in UNWANTED or "hidden" in found or found.get("aria-hidden") == "true"
        or found.get("role", "").lower() in UNWANTED_ROLES or HIDING.search(found.get("style", "")) is not None)
    named = tag not in ("html", "body", "main") and (_around(classes) or _around(found.get("id", "")))
    return ".".join([tag, *sorted({re.sub(r"\d+", "#", c.lower()) for c in classes.split()})]), unwanted, named


class Page:
    """The containers and text blocks of a page; unclosed and stray tags are forgiven."""

    def __init__(self, source: str):
        self.nodes = [Node("", None, "", hash_path(0, ""), 0)]
        self.blocks: list[tuple[Node, str, int]] = []  # container, text, characters in links
        self._containers = [self.nodes[0]]
        self._stack: list[tuple[str, Node | None, bool]] = [("", self.nodes[0], False)]
        self._open: dict[str, int] = {}
        self._parts: list[tuple[str, bool]] = []
        self._links = self._mute = 0  # open links; open inline elements that are left out
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            self._say(source[at:m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if m[1]:
                self._close(tag)
            elif tag:
                self._start(tag, m[3])
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
                    at = end.end() if end else len(source)
                    self._close(tag)
        self._say(source[at:])
        self._flush()
        self._weigh()

    def _say(self, text: str) -> None:
        if text and not self._mute and not self._containers[-1].gone:
            self._parts.append((text, self._links > 0))

    def _flush(self) -> None:
        """What was said so far is a block of the innermost container."""
        if not self._parts:
            return
        text = " ".join(html.unescape("".join([t for t, _ in self._parts])).split())
        if text:
            linked = sum(len("".join(html.unescape(t).split())) for t, link in self._parts if link)
            self.blocks.append((self._containers[-1], text, linked))
        self._parts = []

    def _start(self, tag: str, written: str) -> None:
        if tag in VOID:
            self._say(" ")
            if tag == "hr":
                self._flush()
            return
        if tag in ("html", "body") and self._open.get(tag):
            return
        if tag in CLOSES_P:
            self._end({"p"}, {"table", "td", "th", "button", "object"})
        if tag in ENDS:
            self._end(*ENDS[tag])
        name, unwanted, named = _judged(tag, written) if TELLING.search(written) else (tag, tag in UNWANTED, False)
        if tag in INLINE:
            muted = unwanted or named and tag != "a"
            self._stack.append((tag, None, muted))
            self._mute += muted
            self._links += tag == "a"
        else:
            self._flush()
            above = self._containers[-1]
            node = Node(tag, above, name, hash_path(above.path, name), above.depth + 1, unwanted or above.gone, named)
            self.nodes.append(node)
            self._containers.append(node)
            self._stack.append((tag, node, False))
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop(self) -> None:
        tag, node, muted = self._stack[-1]
        if node is not None:
            self._flush()
            self._containers.pop()
        self._stack.pop()
        self._open[tag] -= 1
        self._mute -= muted
        self._links -= tag == "a"

    def _end(self, tags: set[str], barriers: set[str]) -> None:
        """Close an open element of these tags unless a barrier lies above it."""
        if not any(self._open.get(t) for t in tags):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in barriers:
                return

    def _close(self, tag: str) -> None:
        if tag in ("html", "body") or not self._open.get(tag):
            if tag == "p":
                self._flush()
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                while len(self._stack) > i:
                    self._pop()
                return
            # an inline element does not end blocks, nor a block a table around it
            if tag in INLINE and self._stack[i][1] is not None or self._stack[i][0] == "table":
                return

    def _weigh(self) -> None:
        """Leave out what is around the article, menus without a name too, and score the rest."""
        titles = {id(n.parent) for n in self.nodes if n.tag == "h1"}
        for node in reversed(self.nodes):
            node.main = node.main or node.tag == "main" or node.tag == "article" and not node.named and id(node) in titles
            if node.parent is not None:
                node.parent.main = node.parent.main or node.main
                if node.tag in ("header", "hgroup", "div") and id(node) in titles:
                    titles.add(id(node.parent))
        self._sum()
        for node in self.nodes:
            above = node.parent or node
            node.within = above.within or node.tag in ARTICLES
            node.head = node.tag == "header" or above.head and node.tag not in ARTICLES
            menu = node.tag in LISTS and node.links >= 3 and node.linked >= 0.9 * node.text
            node.gone = (node.gone or menu or above.gone or node.named and not node.main
                         or node.tag == "header" and not node.within and not node.main)
        # of a header in an article only its headings are text
        self.blocks = [b for b in self.blocks if not b[0].gone and (b[0].tag in HEADINGS or not b[0].head)]
        self._sum()
        for owner, text, linked in self.blocks:
            plain = len(text) - 2 * linked
            if owner.tag in HEADINGS or plain <= 0:
                continue
            if owner.tag not in PARAGRAPHS or owner.parent is None:
                owner.score += plain
                above, share = owner.parent, 0.75
            else:
                above, share = owner.parent, 1.0
            while above is not None and share > 0.1:
                if above.tag not in PARTS:
                    above.score += plain * share
                    share /= 2
                above = above.parent

    def _sum(self) -> None:
        for node in self.nodes:
            node.text = node.linked = node.links = 0
            node.blocks = []
        for at, (owner, text, linked) in enumerate(self.blocks):
            owner.text += len("".join(text.split()))
            owner.linked += linked
            owner.links += linked > 0
            owner.blocks = [owner.blocks[0] if owner.blocks else at, at]
        for node in reversed(self.nodes):
            if node.parent is not None:
                node.parent.text += node.text
                node.parent.linked += node.linked
                node.parent.links += node.links
                if node.blocks:
                    both = node.blocks + node.parent.blocks
                    node.parent.blocks = [min(both), max(both)]

    def best(self) -> Node | None:
        """The container of the highest score, or the article or main element around it; none without text."""
        found = max((n for n in self.nodes if not n.gone and n.blocks), key=lambda n: (n.score, n.depth), default=None)
        for tag in ARTICLES:
            node = found
            while node is not None:
                if node.tag == tag:
                    return node
                node = node.parent
        # a heading right before the text belongs to it
        while found is not None and found.parent is not None and found.parent.tag not in ("", "html"):
            before = self.blocks[found.parent.blocks[0]:found.blocks[0]]
            if not before or not all(b[0].tag in HEADINGS for b in before) or found.parent.blocks[1] != found.blocks[1]:
                break
            found = found.parent
        return found

    def path(self, node: Node) -> str:
        """The generalised path as text."""
        names = []
        above: Node | None = node
        while above is not None and above.parent is not None:
            names.append(above.name)
            above = above.parent
        return "/".join(reversed(names))

    def text(self, nodes: list[Node]) -> str:
        """Blocks of some containers in page order."""
        at = sorted({i for n in nodes for i in range(n.blocks[0], n.blocks[1] + 1)})
        return "\n".join(self.blocks[i][1] for i in at)

    def main_text(self, winners: list[int]) -> str:
        """Text of the page's own choice if that won, else of the leading winner it has, else of its own choice."""
        own = self.best()
        if own is None:
            return ""
        if own.path not in winners:
            for path in winners:
                matching = [n for n in self.nodes if n.path == path and not n.gone and n.blocks]
                if matching:
                    most = max(n.score for n in matching)
                    return self.text([n for n in matching if n.score >= most / 5])
        return self.text([n for n in self.nodes if n.path == own.path and n.blocks and not n.gone
                          and (n is own or n.tag not in ARTICLES and n.score >= own.score / 5)])


def host(url: Column) -> Column:
    """Host of an address in lower case; nothing where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes of a batch of (host, html), added up."""
    for batch in batches:
        votes: dict[tuple[str, int], list] = {}
        for name, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Page(source)
            best = page.best()
            if best is not None:
                if (name, best.path) not in votes:
                    votes[name, best.path] = [page.path(best), 0]
                votes[name, best.path][1] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.int64()),
             pa.array([v[0] for v in votes.values()], pa.string()), pa.array([v[1] for v in votes.values()], pa.int64())],
            ["host", "path", "selector", "votes"])


def consensus(pages: DataFrame, url: str = "url", source: str = "html", least: float = 0.1, of_leader: float = 1 / 3) -> DataFrame:
    """(host, path, selector, votes) of the winning containers.

    A path wins with a share of ``least`` of the votes of its host and of ``of_leader`` of
    those of the leading path, so a host has at most 1 / ``least`` winners.
    """
    small_batches(pages.sparkSession)
    votes = (
        pages.select(host(F.col(url)).alias("host"), F.coalesce(F.col(source), F.lit("")).alias("_html"))
        .mapInArrow(_vote, "host string, path long, selector string, votes long")
        .groupBy("host", "path").agg(F.min("selector").alias("selector"), F.sum("votes").alias("votes"))
    )
    votes = durable(votes, "html_votes")
    hosts = votes.groupBy("host").agg(F.max("votes").alias("_lead"), F.sum("votes").alias("_all"))
    return votes.join(hosts, "host").filter(
        (F.col("votes") >= F.col("_all") * least) & (F.col("votes") >= F.col("_lead") * of_leader)
    ).select("host", "path", "selector", "votes")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [Page(source).main_text(winners or []) if source else "" for source, winners in
                 zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", least: float = 0.1,
               of_leader: float = 1 / 3) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: its article, block by block.

    Blocks are what block-level tags separate, in page order, with white space turned into
    single blanks and joined by line ends; a line break is white space. Menus, page headers,
    footers, sidebars, notices, adverts, forms, scripts and comments go, by their elements,
    roles and names, and unnamed lists of links. Null pages are empty, pages without text have
    an empty one; pages without an address share a host of their own; repeated rows are
    answered each. Winners are joined by host: Spark broadcasts them if they are small, and
    splits large hosts if they are not.
    """
    won = durable(
        consensus(pages, url, source, least, of_leader).groupBy("host").agg(
            F.array_sort(F.collect_list(F.struct((-F.col("votes")).alias("votes"), "path"))).alias("_won"))
        .select("host", F.col("_won.path").alias("_won")), "html_winners")
    rows = pages.select(
        F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
        F.coalesce(F.col(source), F.lit("")).alias("_html"), host(F.col(url)).alias("host"))
    return rows.join(won, "host", "left").select("page_id", "url", "_html", "_won").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
