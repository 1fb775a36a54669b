"""HTML extraction with site style trees."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .support import lean, stage

#: Pages that are parsed at once.
BATCH_PAGES = 200
#: Composite importance below which a branch or block goes, and the weight of content (against presentation) in it.
LEAST_IMPORTANCE, CONTENT_WEIGHT = 0.4, 0.9
#: Importance starts at 1, with the weight of so many pages: the fewer pages have a node, the less its entropy says.
PRIOR_PAGES = 3

# Fixed values of HTML: elements without content, blocks, those whose content is no prose, and implied ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
INLINE_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre caption figcaption legend summary".split())
SILENT = frozenset("head script style noscript template svg math iframe object canvas audio video select option datalist textarea button label nav footer aside dialog menu search title".split())
CLOSED = SILENT - BLOCK
SHOWN = CLOSED - {"script", "style", "noscript", "template", "datalist"}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = frozenset("ul ol menu dl table".split())
# Words in class or id, and roles, that name something other than the article.
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs sidebar widget related recommended share sharing social comment comments reply replies disqus footer header masthead copyright newsletter subscribe signup login form search pagination pager skip".split()
)
BESIDE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr popup newsletter subscribe disqus share sharing social comment comments".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
PROTECTED = frozenset("html body main article".split())
NONE: frozenset[str] = frozenset()


def _signature(tag: str, attributes: dict[str, str | None]) -> str:
    names = sorted({*(attributes.get("class") or "").split()})
    return ".".join([tag, *names]) + (f"#{attributes['id']}" if attributes.get("id") else "")


def _is_noise(tag: str, attributes: dict[str, str | None], in_article: bool) -> bool:
    if tag in SILENT or "hidden" in attributes or (attributes.get("role") or "").lower() in NOISE_ROLES:
        return True
    return tag == "header" and not in_article


def _marks(tag: str, attributes: dict[str, str | None], in_article: bool) -> frozenset[str]:
    """The names in class and id that hold a noise word. An article has a header of its own."""
    if tag in PROTECTED or tag == "header" or not (attributes.get("class") or attributes.get("id")):
        return NONE
    words = NOISE_WORDS - {"header"} if in_article else NOISE_WORDS
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().split()
    return frozenset(x for x in names if not words.isdisjoint(re.split(r"[^a-z0-9]+", x)))


def key(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def leaf(branch: tuple[str, ...], text: str) -> int:
    return key("\0".join((*branch, "", text)))


class Page(HTMLParser):
    """The blocks of a page (text, branch of container nodes, in an article) and the containers' children, both
    without noise. Implied ends are supplied; unknown end tags are ignored.

    A name in class or id that holds a noise word marks noise, unless its elements hold more than half of the page's
    text, or of the text of its articles: then it names a layout (no-sidebar, menu-closed), and marks nothing there. A
    name of what stands beside an article (ad) marks it however short the article is. A form is noise in the same way,
    each for itself: one around the page's text, or around its articles, is layout.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, tuple[str, ...], bool]] = []
        self.children: dict[tuple[str, ...], list[str]] = {}
        #: Blocks as found, in parts (text, names that may mark noise), and children with such names.
        self.found: list[tuple[list[tuple[str, frozenset[str]]], tuple[str, ...], bool]] = []
        self.nodes: dict[tuple[str, ...], tuple[list[tuple[str, frozenset[str]]], frozenset[str]]] = {}
        self.forms = 0
        self.open: list[tuple[str, tuple[str, ...], bool, bool, frozenset[str]]] = [("", (), False, False, NONE)]  # tag, branch, in article, noise, marks
        self.parts: list[tuple[str, frozenset[str]]] = []
        self.feed(html)
        self.close()
        self._flush()
        self._settle()

    def _settle(self) -> None:
        total, sums = [0, 0], {}
        for parts, _, in_article in self.found:
            for text, marks in parts:
                n = len(text) - text.count(" ")
                for held in (total, *(sums.setdefault(x, [0, 0]) for x in marks)):
                    held[0] += n
                    held[1] += n * in_article
        noise = {x for x, held in sums.items() if 2 * held[1] <= total[1] and (2 * held[0] <= total[0] or ((x in BESIDE or x[0] == "<") and total[1]))}
        for parts, branch, in_article in self.found:
            text = " ".join("".join(" " if marks and not noise.isdisjoint(marks) else x for x, marks in parts).split())
            if text:
                self.blocks.append((text, branch, in_article))
        for branch, (names, marks) in self.nodes.items():
            if noise.isdisjoint(marks):
                left = [x for x, m in names if noise.isdisjoint(m)]
                self.children[branch] = [x for i, x in enumerate(left) if not i or left[i - 1] != x]  # repeats of a style count once

    def updatepos(self, i: int, j: int) -> int:
        """Line numbers are not needed."""
        return j

    def _flush(self) -> None:
        if any(not x.isspace() for x, _ in self.parts):
            _, branch, in_article, _, _ = next(x for x in reversed(self.open) if not x[3])  # noise gathers no text
            self.found.append((self.parts, branch, in_article))
        self.parts = []

    def _end(self, tag: str, stop: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                if any(x[0] in BLOCK and not x[3] for x in self.open[i:]):
                    self._flush()
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCK:
            self._end("p", CLOSED)
            for other in ENDS.get(tag, ()):
                self._end(other, LISTS | CLOSED)
            if not self.open[-1][3]:
                self._flush()
        if tag == "br":
            self.parts.append((" ", NONE))
        if tag in VOID:
            return
        attributes = dict(attrs)
        _, branch, in_article, noise, marks = self.open[-1]
        noise = noise or _is_noise(tag, attributes, in_article)
        if not noise and (own := _marks(tag, attributes, in_article)):
            marks |= own
        if tag == "form" and not noise:
            self.forms += 1
            marks |= {f"<form {self.forms}>"}
        if tag in SHOWN:
            self.parts.append((" ", NONE))  # a control stands between the words around it
        if tag in BLOCK and not noise:
            name = _signature(tag, attributes)
            seen = self.nodes.setdefault(branch, ([], self.open[-1][4]))[0]
            if not seen or seen[-1] != (name, marks):
                seen.append((name, marks))
            if tag not in INLINE_BLOCK:
                branch = (*branch, name)
                self.nodes.setdefault(branch, ([], marks))
        self.open.append((tag, branch, in_article or (tag in ("article", "main") and not noise), noise, marks))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in BLOCK:
            self._end(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("p", "br") and not any(x[0] == tag for x in self.open):
            self._flush() if tag == "p" else self.parts.append((" ", NONE))
            return
        self._end(tag, frozenset() if tag in BLOCK or tag in SILENT else INLINE_BLOCK)

    def handle_data(self, data: str) -> None:
        if not self.open[-1][3]:
            self.parts.append((data, self.open[-1][4]))


def _tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and page of a host: that a node has a list of children (kind 0) or a block (kind 1; 2 in an article).
    A page is a digest of all that it would count, so that its copies are one page. Noise is not counted, as it goes
    anyway."""
    for batch in batches:
        found: set[tuple[int, int, int, int, int]] = set()
        above: dict[int, list[int]] = {}
        keys: dict[tuple[str, ...], int] = {}
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            page = Page(html or "")
            mine = set()
            for branch, names in page.children.items():
                if branch not in keys:
                    node = keys[branch] = key("\0".join(branch))
                    above[node] = [key("\0".join(branch[:i])) for i in range(1, len(branch) + 1)]
                mine.add((keys[branch], 0, key("\0".join(names))))
            for text, branch, in_article in page.blocks:
                if branch in page.children:
                    mine.add((keys[branch], 1 + in_article, leaf(branch, text)))
            same = key(repr(sorted(mine)))
            found.update((host, *x, same) for x in mine)
        rows = [(*x, above[x[1]] if x[2] else None) for x in found]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 6, kinds, strict=True)], ["host", "node", "kind", "feature", "page", "branch"])


def shrunk(importance: Column, pages: Column) -> Column:
    """Importance by entropy over so many pages, together with PRIOR_PAGES pages of importance 1."""
    return (PRIOR_PAGES + pages * importance) / (PRIOR_PAGES + pages)


def importance(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, node, pages, importance) of the nodes of the site style trees of pages (host, html), and the same of
    their blocks outside articles: from 1 (another on each page, or one page only) down towards 0 (the same on
    many pages). Copies of a page count as one page.

    Presentation: entropy of a node's lists of children over the pages that have it. Content: 1 less the mean
    entropy of the distinct blocks under the node, a block on k of m pages having log k / log m. Both to base m. A
    block by itself has its content only.
    """
    seen = pages.mapInArrow(lean(_tree, BATCH_PAGES), "host long, node long, kind int, feature long, page long, branch array<long>")
    seen = seen.groupBy("host", "node", "kind", "feature", "page").agg(F.first("branch").alias("branch"))  # copies fold
    # Written, as all kinds are read: else each would parse all pages.
    seen = stage(seen.groupBy("host", "node", "kind", "feature").agg(F.count("*").alias("k"), F.first("branch").alias("branch")), "style-counts")
    styles = seen.filter("kind = 0").groupBy("host", "node").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("s"))
    styles = styles.withColumn("presentation", F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0))
    blocks = seen.filter("kind > 0").select("host", F.explode("branch").alias("branch_node"), F.log("k").alias("h"))
    blocks = blocks.groupBy(F.col("host").alias("h_"), F.col("branch_node").alias("n_")).agg(F.sum("h").alias("h"), F.count("*").alias("n"))
    both = styles.join(blocks, (F.col("host") == F.col("h_")) & (F.col("node") == F.col("n_")), "left")
    content = F.when(F.col("m") > 1, F.greatest(F.lit(0.0), 1 - F.col("h") / (F.col("n") * F.log("m")))).otherwise(1.0)
    whole = F.when(F.col("n").isNull(), F.col("presentation")).otherwise((1 - CONTENT_WEIGHT) * F.col("presentation") + CONTENT_WEIGHT * content)
    nodes = both.select("host", "node", F.col("m").alias("pages"), shrunk(whole, F.col("m")).alias("importance"))
    repeated = seen.filter("kind = 1 and k > 1").select(F.col("host").alias("h_"), F.col("node").alias("n_"), "feature", "k")
    alone = repeated.join(styles.select("host", "node", "m"), (F.col("host") == F.col("h_")) & (F.col("node") == F.col("n_")))
    leaves = alone.select("host", F.col("feature").alias("node"), F.col("m").alias("pages"), shrunk(1 - F.log("k") / F.log("m"), F.col("m")).alias("importance"))
    return nodes, leaves


def main_text(html: str | None, unimportant: set[int], cache: dict[tuple[str, ...], bool]) -> str:
    """The blocks that are left: not noise by their markup or by the style tree, and of the article where that holds
    half of what is left."""
    page = Page(html or "")
    kept = []
    for text, branch, in_article in page.blocks:
        if unimportant:
            if branch not in cache:
                cache[branch] = any(branch[i - 1].partition(".")[0].partition("#")[0] not in PROTECTED and key("\0".join(branch[:i])) in unimportant for i in range(1, len(branch) + 1))
            if cache[branch] or (not in_article and leaf(branch, text) in unimportant):
                continue
        kept.append((text, in_article))
    inside = sum(len(text) for text, in_article in kept if in_article)
    if inside and 2 * inside >= sum(len(text) for text, _ in kept):  # a teaser is no article
        kept = [x for x in kept if x[1]]
    return "\n\n".join(text for text, _ in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, caches = [], {}
        nodes = batch.column("nodes").to_pylist()
        for host, html, low in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), nodes, strict=True):
            if host not in caches:
                caches[host] = (set(low or ()), {})
            found.append(main_text(html, *caches[host]))
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", least_importance: float = LEAST_IMPORTANCE) -> DataFrame:
    """One row per row of pages: page_id, url, text and n_chars (code points) of the main text.

    The DOMs of each host are merged into a style tree, whose nodes have an importance by the entropy of what they hold
    on the host's pages, nearer to 1 the fewer pages have them. From each page go the branches below
    least_importance (but html, body, main and article never do), the blocks below it outside articles, and
    the branches whose markup names them (navigation, advert, footer ...), unless the name is on most of the page's or its
    articles' text. Where article and main elements hold half of the rest, only they count. Character references are
    decoded, white space inside a block becomes one space, blocks are joined by an empty line. With
    least_importance=0 the markup decides alone.

    Defined results: null html is empty, its text is empty; pages without a host in their url form one
    host; repeated rows have a result each, but copies of a page of a host are one page of its tree; null page_id and url are kept; an empty table gives an empty result; other columns
    are ignored. The trees are counted in pieces (host, node, block), so a hot host is no hot key. What
    is below least_importance comes to each page of its host in one list; it grows with the host's templates and not with
    its pages, as a block must be on some m ** 0.6 of m pages. The join by host is plain, so that Spark broadcasts these
    lists where they are few and can split a hot host otherwise.
    """
    host = F.xxhash64(F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"^\w+://(?:[^/@?#]*@)?([^/:?#]*)", 1)))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), host.alias("host"))
    nodes, leaves = importance(rows.select("host", "html"))
    low = nodes.unionByName(leaves).filter(F.col("importance") < least_importance)
    low = stage(low.groupBy("host").agg(F.collect_set("node").alias("nodes")), "style-nodes")
    if low.isEmpty():
        rows = rows.withColumn("nodes", F.lit(None).cast("array<long>"))
    else:
        rows = rows.join(low.withColumnRenamed("host", "low_host"), F.col("host") == F.col("low_host"), "left").drop("low_host")
    return rows.mapInArrow(lean(_extract, BATCH_PAGES), "page_id long, url string, text string, n_chars long")
