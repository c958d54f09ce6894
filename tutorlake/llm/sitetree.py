"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: a node is the path of block elements
with their classes and ids, numbers in them blanked; a node's *place* is the text that begins right
in it. Each page is parsed once, into blocks of text with the nodes above them, and written. Counts
over the host's pages that have a node (m of them, equal pages counted once) give its importances:

* presentation: the entropy, to base m, of the node's layouts (the elements that begin in it);
* content: the entropy, to base m, of the texts in it and in all that is below it, 1 where every
  page has texts of its own and 0 where all have the same;
* recurring: the share of those texts, counted by page, that other pages have there too. Where a
  site deals out a stock of menus and adverts, the entropy of a small host says little, this does.

What a page itself says of a block is its *prior*, in log-odds for noise: elements and names of
menus, forms, adverts; blocks of links alone; a line of copyright; text outside the page's
``article`` or ``main``; long running text speaks against. A node's score is the mean prior of its
texts plus what the counts say, between -1 and 1, times (m - 1) / (m + 1): nothing for a single page,
nearly all for a large site, with no step in between. A node with a score above 0 and no clean place
in it is a low branch and is cut from each page of the host, with all below it; a place with a
score of 0 or less is spared, whatever its names. So on a large site the counts find branches
without a name and clear named ones whose texts are fresh, unless the name leaves no doubt; a page
that is its host's only one is judged by its priors.

Running text inside ``article`` or ``main`` is never judged by recurrence, as copies of one article
would then cut each other. ``article`` is not the main element where the page's ``h1`` heads running
text outside, or most running text stands outside. Names count as whole tokens (``ad-hoc-notes`` is
no advert), and those that are also plain words do not count where running text fills the element.

Counting is done by Spark in partial aggregations, so a host with a third of all pages is no hot
spot; the judged nodes, of two pages or more, go to the pages by a broadcast behind their count.

Null or empty html gives an empty text. Pages without a host in their url (null urls too) are no
site and are judged by priors alone. Repeated rows and keys, null keys too, stay rows of their own;
html of any length is read whole; other columns are never looked at, an empty table gives no row.
Unclosed elements end where their parent does, but a menu, header or the like that is never closed
ends at its first running text. Of the elements around a block, the nearest LEVELS are nodes.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tutorlake.llm.common import map_columns, materialize

# What elements, roles and class names stand for.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe button select option textarea svg object canvas head title".split())
NOISE_TAGS = frozenset("nav footer aside form dialog menu".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu breadcrumb breadcrumbs sidebar"
    " footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup share sharing social related recommended"
    " comments comment commentlist disqus respond replies pagination pager toolbar widget login copyright disclaimer".split()
)
COMMENT_NAMES = frozenset("comment comments commentlist respond replies".split())
#: Names that are plain words as well: they do not count where running text fills the element.
PLAIN_NAMES = frozenset("promo promotion banner notice notices alert related recommended share sharing social login copyright disclaimer subscribe signup menu masthead toolbar popup".split())
#: What a name may be joined with and still stand for the same thing.
JOINED_WITH = frozenset(
    "area bar block body box bottom button buttons column container content footer global group header inner item items left link links list main minor outer page panel"
    " placeholder post posts primary right row secondary section site slot sticky sub top unit wrap wrapper".split()
)
BLOCKS = frozenset(
    "address article blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre"
    " section summary table tbody tfoot thead tr ul aside".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that a new block of the same kind ends.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Tags that are running text rather than a branch of the layout.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 b i em strong a span br blockquote pre code q li ul ol dl dt dd sup sub u s small mark table tbody thead tr td th figure figcaption".split())
#: Elements that a forgotten end tag does not stretch over running text.
ENDED_BY_TEXT = frozenset("nav header aside menu form dialog".split())
#: Elements whose own name says nothing of the text in them.
UNNAMED = HEADINGS | frozenset("figure figcaption blockquote pre table".split())
LEAST = 0.3
OFTEN = 0.35
VARIES = 0.6
#: Log-odds for noise of what a page itself says of a block.
NAMED, PLAINLY_NAMED, OUTSIDE, ONLY_LINKS, COPYRIGHT, LONG_TEXT = 3.0, 2.0, 2.0, 0.75, 0.75, -0.5
#: Characters of running text in a paragraph and in an element that speak for content.
LONG, FILLED = 80, 200
#: A node with a place of this score or less has clean text in it; so has one with long running text at 0 or less.
CLEAN_PLACE = -0.5
#: Judged nodes that may be broadcast.
MOST_NODES = 500_000
LEVELS = 32

_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_NUMBER = re.compile(r"[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"^(©|\(c\)|copyright\b)|\ball rights reserved\b", re.I)


def _names(label: str) -> set[str]:
    """The noise names among the tokens of a class and id: alone or joined with words of position."""
    found = set()
    for token in label.split():
        parts = {p.lower() for p in _NAME.findall(token) if len(p) > 1 and not p.isdigit()}
        named = parts & NOISE_NAMES or parts & {"header"}
        if named and parts <= NOISE_NAMES | JOINED_WITH:
            found |= named
    return found


def _hash(text: str) -> int:
    h = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


class _Branch:
    """An element that stands for noise: its log-odds, whether running text may clear it, and the
    number of the first block that a forgotten end tag leaves out of it."""

    __slots__ = ("odds", "plain", "tag", "closed", "until")

    def __init__(self, odds: float, plain: bool, tag: str):
        self.odds, self.plain, self.tag, self.closed, self.until = odds, plain, tag, False, None


class _Open:
    """An open element. ``chain``: hashes of the block elements from below body down to it."""

    __slots__ = ("tag", "block", "path", "chain", "dropped", "branches", "inside", "running", "link", "layout", "own")

    def __init__(self, tag, block="", path="", chain=(), dropped=False, branches=(), inside=None, running=False, link=False, layout=None, own=None):
        self.tag, self.block, self.path, self.chain, self.dropped, self.branches = tag, block, path, chain, dropped, branches
        self.inside, self.running, self.link, self.layout, self.own = inside, running, link, layout, own


class _Block:
    """A block of text; ``inside``: the tag of the main element around it, ``linked``: its characters in links."""

    __slots__ = ("text", "chain", "branches", "inside", "judged", "tag", "linked", "byline", "prior")

    def __init__(self, at: _Open, byline: bool):
        self.chain, self.branches, self.inside, self.judged, self.tag, self.byline = at.chain, at.branches, at.inside, not at.running, at.block, byline

    def prose(self) -> bool:
        return self.tag not in ("li", "ul", "ol", "nav", "menu") and self.tag not in HEADINGS and 2 * self.linked < len(self.text)


class _Page(HTMLParser):
    """Blocks of a page, each with its prior, and the layouts of its nodes: [node, styles that begin in it]."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.open: list[_Open] = [_Open("")]
        self.blocks: list[_Block] = []
        self.layouts: list[tuple[int, list[str]]] = []
        self.text: list[str] = []
        self.linked = 0
        self.at: _Block | None = None
        self.feed(html)
        self.close()
        self._end()
        self._judge()

    def _end(self) -> None:
        text = " ".join("".join(self.text).split())
        if text and self.at:
            self.at.text, self.at.linked = text, self.linked
            self.blocks.append(self.at)
        self.text, self.linked, self.at = [], 0, None

    def handle_starttag(self, tag: str, attrs) -> None:
        block = tag in BLOCKS
        if tag == "br":
            self.text.append(" ")
            return
        if block:
            self._end()
            if any(x.tag == "p" for x in self.open):
                self._shut("p", BLOCKS - {"p"})
        elif tag in ("td", "th"):
            self.text.append(" ")
        if tag in VOID:
            return
        for other in CLOSED_BY.get(tag, ()):
            self._shut(other, {"ul", "ol", "dl", "table", "tbody", "select"})
        up = self.open[-1]
        got = {k: v or "" for k, v in attrs}
        label = " ".join(got[k] for k in ("class", "id") if k in got)
        role = got.get("role")
        main = tag in ("article", "main") or role == "main"
        branches, own = () if tag == "main" else up.branches, None
        dropped = up.dropped or tag in UNREAD or "hidden" in got or bool(_HIDDEN.search(got.get("style", "")))
        if not dropped:
            names = _names(label) if label and tag not in UNNAMED else set()
            if main:
                names &= COMMENT_NAMES
            header = (tag == "header" or "header" in names) and not up.inside
            sure = header or tag in NOISE_TAGS or role in NOISE_ROLES or bool(names - PLAIN_NAMES - {"header"})
            if sure or names - {"header"}:
                own = _Branch(NAMED if sure else PLAINLY_NAMED, not sure, tag)
                branches = (*branches, own)
                dropped = not block
        style = tag + ("." + ".".join(sorted(_NUMBER.sub("0", label).split())) if label else "")
        if up.layout is not None and block:
            up.layout.append(style)
        running = main or up.running and tag in RUNNING and not label
        running |= tag in HEADINGS and bool(up.inside) and not branches and any(x.tag == "header" for x in self.open)
        path, chain, layout = f"{up.path}>{style}", up.chain, up.layout
        if block and tag != "html":
            node = _hash(path)
            chain, layout = (*chain[1 - LEVELS :], node), []
            self.layouts.append((node, layout))
        inside = "main" if main and tag != "article" else up.inside or ("article" if main else None)
        self.open.append(_Open(tag, tag if block else up.block, path, chain, dropped, branches, inside, running, up.link or tag == "a", layout, own))

    def _shut(self, tag: str, walls) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self._end()
                del self.open[i:]
                return
            if self.open[i].tag in walls:
                return

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # a slash does not close an element in html

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._end()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                if self.open[i].own:
                    self.open[i].own.closed = True
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        x = self.open[-1]
        if x.dropped:
            return
        if self.at is None and not data.isspace():
            byline = bool(x.inside) and any(o.tag == "header" for o in self.open) and not any(o.tag in HEADINGS for o in self.open)
            self.at = _Block(x, byline)
        if x.link:
            self.linked += len(data)
        self.text.append(data)

    def _judge(self) -> None:
        """The prior of each block, from the whole page."""
        filled: dict[_Branch, int] = {}
        for i, b in enumerate(self.blocks):
            for x in b.branches if b.prose() else ():
                filled[x] = filled.get(x, 0) + len(b.text) - 2 * b.linked
                if x.until is None and not x.closed and x.tag in ENDED_BY_TEXT and b.tag != x.tag:
                    x.until = i
        for i, b in enumerate(self.blocks):
            odds = [x.odds for x in b.branches if (x.until is None or i < x.until) and not (x.plain and filled.get(x, 0) >= FILLED)]
            b.prior = max(odds, default=PLAINLY_NAMED if b.byline else 0.0)
        self._weigh(*self._main())

    def _main(self) -> tuple[bool, bool]:
        """Whether the page has a main element, and whether its story stands outside its articles."""
        clean = [b for b in self.blocks if not b.prior]
        inside = [b for b in clean if b.inside]
        if not inside or any(b.inside == "main" for b in inside):
            return bool(inside), False
        outside = [b for b in clean if not b.inside and b.prose()]
        around = {b.chain[:-1] for b in outside}
        headed = any(b.tag == "h1" and not b.inside and b.chain[:-1] in around for b in clean) and not any(b.tag == "h1" for b in inside)
        told, other = (sum(len(b.text) for b in x if b.prose()) for x in (inside, outside))
        return True, headed or other >= max(2 * told, FILLED)

    def _weigh(self, has_main: bool, story: bool) -> None:
        prose = any(b.prose() and not b.prior for b in self.blocks)
        for b in self.blocks:
            if has_main and story == bool(b.inside):
                b.prior += OUTSIDE
            if story:
                b.judged = True
            if not b.inside:
                b.prior += ONLY_LINKS * (prose and b.linked >= 0.8 * len(b.text))
                b.prior += COPYRIGHT * bool(_RIGHTS.search(b.text) and len(b.text) < 2 * LONG)
                b.prior += LONG_TEXT * (b.prose() and len(b.text) >= LONG)


def parse(html: str) -> _Page:
    return _Page(html)


def text_of(page: _Page) -> str:
    """The main text of a page that stands alone: its blocks without a prior for noise."""
    return "\n\n".join(b.text for b in page.blocks if b.prior <= 0)


def host(url: str) -> Column:
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")), F.lit("")))


def parsed(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, host, same, blocks, layouts) of every page; ``same`` is equal for pages of equal
    blocks."""
    kind = df.schema[key].dataType.simpleString()
    df = df.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host(url).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))

    def run(c):
        out = {k: [] for k in ("same", "blocks", "layouts")}
        for x in c["html"]:
            page = parse(x)
            out["same"].append(_hash("\0".join(b.text for b in page.blocks)))
            out["blocks"].append([{k: getattr(b, k) for k in ("text", "chain", "prior", "judged")} for b in page.blocks])
            out["layouts"].append([{"node": n, "layout": _hash(" ".join(styles))} for n, styles in {n: s for n, s in page.layouts}.items()])
        return {k: c[k] for k in ("page_id", "url", "host")} | out

    blocks = "array<struct<text:string,chain:array<long>,prior:float,judged:boolean>>"
    return map_columns(df, f"page_id {kind}, url string, host string, same long, blocks {blocks}, layouts array<struct<node:long,layout:long>>", "html", lambda: run)


def _place(chain: Column) -> Column:
    """The id of the place of the text right in the last node of a chain."""
    return F.bitwise_not(F.element_at(chain, -1))


def style_tree(pages: DataFrame, least: float = LEAST, often: float = OFTEN, names: bool = True) -> DataFrame:
    """(host, node, is_place, pages, presentation, content, recurring, prior, score, cleanest) of each
    style node and place, from ``parsed`` pages; ``cleanest`` is the least score of a place in it.
    Without ``names`` every prior is 0."""
    sites = pages.where("host <> ''")
    entropy = lambda n, total: F.log(total) - F.sum(n * F.log(n)) / total
    layouts = sites.select("host", "same", F.inline("layouts")).distinct().groupBy("host", "node", "layout").agg(F.count("*").cast("double").alias("n"))
    layouts = layouts.groupBy("host", F.col("node").alias("of")).agg(F.sum("n").alias("pages"), entropy(F.col("n"), F.sum("n")).alias("layout_entropy"))
    texts = sites.select("host", "same", F.explode("blocks").alias("b")).where(F.size("b.chain") > 0)
    texts = texts.groupBy("host", "same", "b.chain", F.xxhash64("b.text").alias("t")).agg((F.max("b.prior") if names else F.lit(0.0)).cast("double").alias("prior"))
    texts = texts.groupBy("host", "chain", "t").agg(F.count("*").cast("double").alias("n"), F.sum("prior").alias("prior"))
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0.0))
    own = texts.groupBy("host", "chain").agg(F.sum("n").alias("texts"), F.sum(F.col("n") * F.log("n")).alias("shared"), again.alias("again"), F.sum("prior").alias("prior"))
    bound = lambda x: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))
    sure = lambda n: (n - 1) / (n + 1)
    recurs = F.col("again") / F.col("texts") / often - 1
    own = own.withColumn("cleanest", sure(F.col("texts")) * bound(recurs) + F.col("prior") / F.col("texts"))
    own = own.withColumn("cleanest", F.when((F.col("prior") < 0) & (F.col("cleanest") <= 0), CLEAN_PLACE).otherwise(F.col("cleanest")))
    nodes = F.transform("chain", lambda c: F.struct(c.alias("node"), c.alias("of")))
    place = F.array(F.struct(_place(F.col("chain")).alias("node"), F.element_at("chain", -1).alias("of")))
    texts = own.select("host", F.inline(F.concat(nodes, place)), "texts", "shared", "again", "prior", "cleanest")
    texts = texts.groupBy("host", "node", "of").agg(*(F.sum(c).alias(c) for c in ("texts", "shared", "again", "prior")), F.min("cleanest").alias("cleanest"))
    m = F.greatest(F.log("pages"), F.lit(1e-9))
    tree = layouts.join(texts, ["host", "of"]).select(
        "host",
        "node",
        (F.col("node") != F.col("of")).alias("is_place"),
        F.col("pages").cast("long").alias("pages"),
        F.when(F.col("pages") > 1, F.col("layout_entropy") / m).otherwise(1.0).alias("presentation"),
        F.when(F.col("pages") > 1, 1 - F.col("shared") / F.col("texts") / m).otherwise(1.0).alias("content"),
        (F.col("again") / F.col("texts")).alias("recurring"),
        (F.col("prior") / F.col("texts")).alias("prior"),
        "cleanest",
    )
    low = F.greatest(F.col("recurring") / often - 1, (least - F.col("content")) / least)
    counted = bound(F.when(F.col("presentation") < VARIES, low).otherwise(F.least(low, F.lit(0.0))))
    return tree.withColumn("score", sure(F.col("pages")) * counted + F.col("prior"))


def judged_nodes(tree: DataFrame) -> DataFrame:
    """(host, node, low): the low branches of each host, and the places that are spared though their
    priors speak for noise. Nodes of one page have no counts to be judged by."""
    low = (F.col("score") > 0) & (F.col("cleanest") > CLEAN_PLACE)
    spared = F.col("is_place") & (F.col("prior") > 0) & (F.col("score") <= 0)
    return tree.where((F.col("pages") > 1) & (low | spared)).select("host", "node", low.alias("low"))


def extract(df: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least: float = LEAST, often: float = OFTEN, names: bool = True, counts: bool = True) -> DataFrame:
    """(page_id, url, text, n_blocks, n_low, n_named) of every page: the main text, the blocks of the
    page, those in low branches, and those that only the page's own priors cut. Without ``names`` the
    counts alone decide, over all blocks, without ``counts`` each page alone."""
    pages = materialize(parsed(df, key, url, html))
    none = F.array().cast("array<long>")
    if counts:
        nodes = materialize(judged_nodes(style_tree(pages, least, often, names)))
        sets = nodes.groupBy("host").agg(F.collect_set(F.when(F.col("low"), F.col("node"))).alias("low"), F.collect_set(F.when(~F.col("low"), F.col("node"))).alias("spared"))
        pages = pages.join(F.broadcast(sets) if nodes.count() <= MOST_NODES else sets, "host", "left").withColumns({c: F.coalesce(c, none) for c in ("low", "spared")})
    else:
        pages = pages.withColumns({"low": none, "spared": none})
    in_tree = lambda b: F.size(b["chain"]) > 0
    judged = lambda b: (b["judged"] if names else F.lit(True)) & in_tree(b)
    is_low = lambda b: F.when(judged(b), F.arrays_overlap(b["chain"], "low") | F.array_contains("low", _place(b["chain"]))).otherwise(False)
    spared = lambda b: F.when(in_tree(b), F.array_contains("spared", _place(b["chain"]))).otherwise(False)
    out = lambda b: (b["prior"] > 0) & ~spared(b) if names else F.lit(False)
    count = lambda f: F.size(F.filter("blocks", f))
    return pages.select(
        "page_id",
        "url",
        F.array_join(F.transform(F.filter("blocks", lambda b: ~is_low(b) & ~out(b)), lambda b: b["text"]), "\n\n").alias("text"),
        F.size("blocks").alias("n_blocks"),
        count(is_low).alias("n_low"),
        count(lambda b: out(b) & ~is_low(b)).alias("n_named"),
    )
