"""Main text of web pages, with removal of the templates that a site repeats.

Each page is parsed once into text blocks. Every subtree of elements is hashed with its text
and counted by host in Spark; those that recur on at least ``min_pages`` pages of a host, however many it has, are templates, and
every block in one is deleted. The text is that of the page's article (the longest ``article``, else ``main``, else the
whole body). What authors write may recur too: inside an article only link-dense subtrees and boxes count, a box being a container with a class or an id, or without a heading, so headings, paragraphs and sections that many articles share
stay; elsewhere a heading doesn't count by itself. A page whose templates would be more than half of its article is a
reprint: an article that a site prints on many pages stays, and only link-dense templates leave it.

What a template count can't see is furniture whose words differ from page to page, such as adverts and reader comments. It goes by element
and role, and by a class or id that says nothing else: every word of it is one of ``NAMES`` or of ``PLACES``, so ``post-comments`` goes and
``has-sidebar`` stays. Such a name never removes what is around the article. An ``article`` goes by name only if a class is one of ``NAMES`` as it stands. Inside an article names that authors use too (``WEAK``) need link density or a template count
beside them where the element has another name too, and paragraphs, headings and items go only by the names of adverts, comments and the like (``SURE``). A form goes with all it holds, unless the article or most of a long page stands in it: then it is layout, and its labels and
controls go.

Null and empty html, and pages without text, give an empty string and 0. Unclosed and misnested elements are closed where the next block needs it; unknown ones are
inline. Repeated rows are treated each. A null url is a host of its own, the empty one. Extra columns pass through; ``text`` and ``n_chars`` of the input are replaced, and
names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daybook.llm.text import text_steps
from daybook.operators.durable import save, scratch
from daybook.operators.skew import lookup

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
#: Elements that never hold an article's text.
FURNITURE = frozenset("head script style noscript template nav footer aside iframe svg button select option textarea dialog menu object canvas audio video title".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class names and ids that mark furniture, and words that may stand beside them.
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense alert banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies respond share sharebar sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget".split()
)
PLACES = frozenset(
    "site page main post posts entry article story user reader readers blog top bottom left right primary secondary global sticky fixed mobile desktop list item items box block wrap wrapper container inner outer area section bar slot unit panel row col column link links form title head header foot icon icons button small large x news stories".split()
)
#: Names that authors give to their own text too, and those that mean furniture wherever they stand.
WEAK = frozenset("alert banner copyright related share sharebar sharing skip social".split())
SURE = frozenset("ad ads advert adverts advertisement adsense comment comments consent cookie cookies disqus gdpr login newsletter promo promoted promotion replies respond signup sponsor sponsored subscribe".split())
#: Blocks that hold text themselves; the others are containers.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre figcaption caption".split())
#: Letters from which on a form that holds most of a page is its layout.
LAYOUT = 500
#: Elements that a new block of the same kind closes: opened element -> elements it closes, and where the search stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr",), "tbody": ("thead", "tr"), "body": ("head",)}
#: Pages and blocks of them up to which the places of templates are broadcast; more are joined by page.
BROADCAST, BITS = 200_000, 24
SCOPES = frozenset("ul ol dl table select div section article main body html".split())
#: Headings, which the word header in a class doesn't make furniture.
BLOCKS_OF_TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


def _named(attrs: dict[str, str | None], whole: bool, names: frozenset[str] = NAMES) -> bool:
    """Whether a class or the id is a name of furniture with one of ``names`` in it; ``whole`` names have no word beside it."""
    for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split():
        words = _NAME.findall(token)
        if names.intersection(words) and (len(words) == 1 or not whole and all(w in NAMES or w in PLACES for w in words)):
            return True
    return False


class Node:
    __slots__ = ("tag", "parent", "digest", "code", "chars", "linked", "hard", "named", "weak", "boxed", "labelled", "dropped", "article", "main", "holds", "titled")

    def __init__(self, tag: str, parent: Node | None, attrs: dict[str, str | None]):
        self.tag, self.parent = tag, parent
        self.digest = xxhash.xxh3_64(tag)
        self.code = 0
        self.chars = self.linked = 0
        up = parent
        self.article = self if tag == "article" and not (up and up.article) else (up.article if up else None)
        self.main = self if (tag == "main" or attrs.get("role") == "main") and not (up and up.main) else (up.main if up else None)
        self.hard = self._furniture(attrs)  # by element or role
        inside = (self.article or self.main) and self.article is not self and self.main is not self
        names = NAMES if not inside else SURE if tag in TEXTUAL else NAMES - WEAK
        self.named = tag not in ("html", "body", "main") and (_named(attrs, tag == "article", names) or tag not in BLOCKS_OF_TITLES and not self.article and not self.main and "header" in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split())
        self.weak = bool(inside) and not self.named and tag not in TEXTUAL and _named(attrs, tag == "article")
        if self.weak and all(NAMES.intersection(_NAME.findall(token)) for token in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower().split()):
            self.named, self.weak = True, False  # it is called nothing else
        self.boxed = tag in BLOCKS and tag not in TEXTUAL
        self.labelled = bool(attrs.get("class") or attrs.get("id"))
        self.holds = self.titled = False  # an article stands in it, a heading does
        self.dropped = bool(up and up.dropped) or self.hard or self.named

    def _furniture(self, attrs: dict[str, str | None]) -> bool:
        tag = self.tag
        if tag in FURNITURE or tag == "header" and not self.article and not self.main:
            return True
        if tag in ("html", "body", "main"):
            return False
        if tag in ("label", "legend", "fieldset") and any(x.tag == "form" for x in _up(self.parent)):
            return True
        return "hidden" in attrs or attrs.get("role") in ROLES or attrs.get("aria-hidden") == "true"


class Page(HTMLParser):
    """Blocks of a page, each with the node that it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.node = Node("#page", None, {})
        self.root = self.node
        self.blocks: list[tuple[str, Node]] = []
        self.buffer: list[str] = []
        self.anchors = self.in_links = 0  #: open ``a`` elements, and letters of the buffer that came while one was open
        self.closed: list[Node] = []

    def _flush(self) -> None:
        if self.buffer:
            text = SPACE.sub(" ", "".join(self.buffer)).strip()
            linked, self.in_links = min(self.in_links, len(text)), 0
            self.buffer.clear()
            if text:
                self.blocks.append((text, self.node))
                self.node.digest.update(text)
                at: Node | None = self.node
                while at:
                    at.chars += len(text)
                    at.linked += linked
                    at = at.parent

    def _close(self) -> None:
        """Close the innermost element."""
        self._flush()
        node = self.node
        node.code = node.digest.intdigest() - (1 << 63)
        if node.parent:
            node.parent.digest.update(f"<{node.code}>")
            self.node = node.parent
        self.anchors -= node.tag == "a"
        self.closed.append(node)

    def _close_until(self, tags: tuple[str, ...], stop: frozenset[str]) -> None:
        at, depth, hit = self.node, 0, 0
        while at.parent and at.tag not in stop:
            depth += 1
            if at.tag in tags:
                hit = depth
            at = at.parent
        for _ in range(hit):
            self._close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._flush()
            if tag in CLOSES:
                self._close_until(CLOSES[tag], SCOPES)
            elif tag != "br" and tag not in VOID:
                self._close_until(("p",), SCOPES | frozenset(("li", "td", "th", "blockquote")))
        if tag in VOID:
            if tag in ("br", "hr"):
                self.buffer.append(" ")
            return
        self.node = Node(tag, self.node, dict(attrs))
        self.anchors += tag == "a"

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        at, depth = self.node, 1
        while at.parent and at.tag != tag:
            if tag not in BLOCKS and at.tag in BLOCKS:
                return  # a stray inline end tag
            at, depth = at.parent, depth + 1
        if not at.parent:
            return
        if tag in BLOCKS:
            self._flush()
        for _ in range(depth):
            self._leave(tag)

    def _leave(self, tag: str) -> None:
        node = self.node
        if node.tag in BLOCKS or node.tag in FURNITURE or not self.buffer:
            self._close()
            return
        # an inline element: its text goes on into the block around it
        node.code = node.digest.intdigest() - (1 << 63)
        self.anchors -= node.tag == "a"
        self.node = node.parent

    def handle_data(self, data: str) -> None:
        if self.node.tag in ("script", "style"):
            return
        if (self.node.hard or self.node.named) and self.buffer and self.node.tag not in BLOCKS and self.node.parent and not self.node.parent.dropped:
            return  # furniture in the middle of a sentence: its words aren't the block's
        self.buffer.append(data)
        if self.anchors:
            self.in_links += len(SPACE.sub(" ", data))

    def finish(self) -> None:
        self.close()
        while self.node.parent:
            self._close()
        self._flush()


#: What happens to a subtree that recurs: it goes, goes unless the page is a reprint, or stays and only tells a reprint.
GOES, BOX, TEXT = 0, 1, 2


def parse(html: str) -> tuple[list[tuple[str, bool, list[tuple[int, int]]]], list[int]]:
    """``(blocks, subtrees)``: text, whether it may be main text, the hashes of the subtrees around it that count as possible templates, each with what happens if it is one; and these hashes once each."""
    page = Page()
    page.feed(html)
    page.finish()
    for n in page.closed:
        if n.chars and (n.article is n or n.main is n):
            for x in _up(n.parent):
                x.holds = True
        if n.tag in BLOCKS_OF_TITLES:
            for x in _up(n.parent):
                if x.titled:
                    break
                x.titled = True
    letters = page.root.chars
    form = lambda x: x.tag == "form" and not x.holds and not (x.chars >= LAYOUT and 2 * x.chars > letters)
    hard = lambda x: x.hard or form(x)
    free = lambda n: not any(hard(x) for x in _up(n))
    within: Node | None = None
    for choice in ([n for n in page.closed if n.tag == "article" and n.article is n and n.chars], [n for n in page.closed if n.main is n and n.chars]):
        # one that stands in furniture by name only if no other is left, and never one in furniture by element
        found = [n for n in choice if not n.dropped] or [n for n in choice if not n.named and free(n)]
        if found:
            within = max(found, key=lambda n: n.chars)  # the first of the longest
            break
    blocks, seen = [], {}
    for text, node in page.blocks:
        inside = within is None
        chain: list[tuple[int, int]] = []
        path = []
        at: Node | None = node
        while at and at.tag not in ("#page", "html", "body"):
            path.append(at)
            at = at.parent
        inside = inside or within in path
        for n in path:
            if n is within:
                break
            dense = 2 * n.linked > n.chars
            if n.code and (dense or within and inside or n.tag not in BLOCKS_OF_TITLES):
                box = n.boxed and (n.labelled or not n.titled)
                chain.append((n.code, GOES if dense or not (within and inside) else BOX if box else TEXT))
                seen[n.code] = None
        inner = path[: path.index(within)] if within and inside else path
        blocks.append((text, inside and not any(hard(x) or x.named or x.weak and 2 * x.linked > x.chars for x in inner), chain))
    return blocks, list(seen)


def _up(node: Node | None) -> Iterator[Node]:
    while node:
        yield node
        node = node.parent


def _parsed(rows: DataFrame, html: str) -> DataFrame:
    """``rows`` with ``__row, __blocks, __subtrees`` in place of the html. The other columns cross the worker untouched, so nothing is joined back by page."""
    others = [f for f in rows.schema.fields if f.name not in (html, "__row")]
    block = pa.struct([("text", pa.string()), ("chain", pa.list_(pa.struct([("code", pa.int64()), ("kind", pa.int8())])))])
    schema = "__row long, __blocks array<struct<text:string, chain:array<struct<code:long, kind:tinyint>>>>, __subtrees array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_steps(batches, html, 1_000_000):
            parsed = [parse(x or "") for x in batch.column(html).to_pylist()]
            blocks = pa.array([[{"text": t.encode("utf-8", "replace").decode(), "chain": [{"code": x, "kind": y} for x, y in c]} for t, main, c in found if main] for found, _ in parsed], pa.list_(block))
            subtrees = pa.array([s for _, s in parsed], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("__row"), blocks, subtrees, *(batch.column(f.name) for f in others)], names=["__row", "__blocks", "__subtrees", *(f.name for f in others)])

    return rows.mapInArrow(run, ", ".join([schema, *(f"`{f.name}` {f.dataType.simpleString()}" for f in others)]))


def _hits(gone: DataFrame):
    """A test of a row's hash against a bitmap of ``2 ^ BITS`` hashes of the rows of ``gone``, whatever their number; it may say yes to others. The bitmap's rows reach the driver packed by 4096 hashes."""
    bit = F.pmod(F.xxhash64("__row"), F.lit(1 << BITS))
    flags = np.zeros(1 << BITS, dtype=bool)
    for r in gone.groupBy(F.floor(bit / 4096).alias("page")).agg(F.collect_set(bit).alias("at")).toLocalIterator():
        flags[r["at"]] = True
    packed = np.packbits(flags, bitorder="little")  # 2 MB

    @F.pandas_udf("boolean")
    def may(h: pd.Series) -> pd.Series:
        at = h.to_numpy().astype(np.int64) % (1 << BITS)
        return pd.Series((packed[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool))

    return may


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_pages: int = 5) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of the html."""

    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    places = ["__gone", "__boxes", "__same"]  # of blocks in templates, by what happens to them
    rows = pages.withColumn("__row", F.monotonically_increasing_id())
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))
    with scratch() as keep:
        parsed = keep(save(_parsed(rows.select("__row", html, host.alias("__host"), *others), html), "blocks"))
        seen = parsed.select("__host", F.explode("__subtrees").alias("code")).groupBy("__host", "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
        templates = save(seen.select(F.xxhash64("__host", "code").alias("template"), "n", F.lit(True).alias("found")), "templates")
        codes = parsed.select("__row", "__host", F.posexplode("__blocks.chain").alias("i", "chain")).select("__row", "__host", "i", F.explode("chain").alias("at"))
        placed = codes.select("__row", "i", F.xxhash64("__host", "at.code").alias("template"), "at.kind")
        total = parsed.select(F.sum(F.size("__subtrees"))).first()[0] or 1
        hit = lookup(placed, templates, "template", "n", total, ["found"]).where("found")
        # a page's blocks are one row of few numbers; while few pages have any, the texts stay where they are
        gone = keep(save(hit.groupBy("__row").agg(*(F.collect_set(F.when(F.col("kind") == kind, F.col("i"))).alias(name) for kind, name in enumerate(places))), "gone"))
        blocks = gone.agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.size(c) for c in places), F.lit(0))).alias("m")).first()
    texts = parsed.select("__row", *others, F.col("__blocks.text").alias("__texts"))  # the hashes have done their work and aren't shuffled
    none = F.array().cast("array<int>")
    if blocks.n + (blocks.m or 0) <= BROADCAST:
        marked = texts.join(F.broadcast(gone), "__row", "left")
    else:  # only pages that may have some are shuffled
        may = _hits(gone)(F.xxhash64("__row"))
        marked = texts.where(may).join(gone, "__row", "left").unionByName(texts.where(~may).withColumns(dict.fromkeys(places, none)))
    but = lambda n: F.filter("__texts", lambda t, i: ~F.array_contains(F.concat(*(F.coalesce(c, none) for c in places[:n])), i))
    size = lambda texts: F.aggregate(texts, F.lit(0), lambda n, t: n + F.length(t))
    marked = marked.withColumns({"__left": but(1), "__fresh": but(2), "__own": but(3)})
    kept = F.when(2 * size("__own") >= size("__left"), F.col("__fresh")).otherwise(F.col("__left"))  # else a reprint
    marked = marked.withColumn("text", F.array_join(kept, " ")).withColumn("n_chars", F.length("text").cast("long"))
    return marked.select(*others, "text", "n_chars")
