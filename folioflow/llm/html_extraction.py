"""Main text of web pages by site style trees.

The pages of a host are merged into one tree: an element's place is the path of its
ancestors' and its own presentation (tag, id, classes).  Each place has two distributions
over the distinct pages that show it: the presentation of its children, and its text.
Their entropies, over the logarithm of the number of pages, measure its importance: menus,
imprints and slogans look and read alike on all pages of a site, texts do not.  Places
seen on MIN_PAGES pages whose weighted importance is under THRESHOLD are left out of each page.

What the markup itself says goes first: elements for navigation, page headers and footers,
asides, forms, scripts, styles, notices, adverts and comments, by tag, role or class,
are left out, unless they hold all articles or most of the text of the page.  All other
places are judged by the tree, within articles and outside of them.  A marked article or
main part is protected: the tree takes neither it, nor what holds it, nor its headings,
table cells and inline elements, but does take what a site repeats in it,
as long as most of the page's text stays.

Defined cases: a null or empty html gives an empty text; a null url belongs to the empty
host; equal pages of a host count once in its tree; repeated rows give repeated rows; tags
that never close, misnested or cut off are read as browsers do as far as text goes;
further columns pass through ``extract``, and ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import BROADCAST_ROWS, salted_join, table, written
from ._dom import INLINE, Node, blocks, parse
from .url_filters import url_parts

MIN_PAGES, THRESHOLD = 5, 0.2
#: Weight of the presentation's entropy; the rest is the content's.
STYLE_WEIGHT = 0.3
NOISE_TAGS = frozenset("nav footer aside form script style noscript template iframe object svg canvas button select option dialog menu head title textarea audio video".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form status tooltip".split())
#: Class and id names that consist of such words, and of words for boxes.
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs masthead footer comment comments reply replies disqus discussion respond share sharing social related recommended recommendations newsletter subscribe signup login toolbar pagination pager copyright skip".split()
)
CONTENT_WORDS = frozenset("article entry post content story main".split())
#: Words that say where or what kind of box a noise word's element is: "site-footer", "share-buttons".
BOX_WORDS = frozenset("site page main global top bottom left right box block bar list wrap wrapper container area section widget links link buttons button items item inner slot unit group form".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond disqus".split())
#: Articles of these names are not what a page is about.
CARD_WORDS = COMMENT_WORDS | frozenset("card cards teaser teasers".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CELLS = frozenset("thead tbody tfoot tr td th caption".split())
UNSEEN_TAGS = frozenset("script style noscript template iframe object svg canvas button select option head title textarea audio video".split())


def words(value: str) -> set[str]:
    return set(re.findall(r"[a-z0-9]+", value.lower()))


def names(node: Node) -> set[str]:
    return words(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}") if node.attrs else set()


def noise_names(value: str) -> set[str]:
    """The noise words of whole names: of "cookie-notice" and "site-footer", but not of "has-sidebar" or "related-work"."""
    found: set[str] = set()
    for name in value.lower().split():
        parts = words(name)
        if parts & NOISE_WORDS and parts <= NOISE_WORDS | BOX_WORDS:
            found |= parts & NOISE_WORDS
    return found


def marked(node: Node) -> bool:
    """Whether the markup calls it an article or the main part."""
    if node.tag in ("article", "main"):
        return not words(node.attrs.get("class", "")) & CARD_WORDS
    return bool(node.attrs) and node.attrs.get("role", "").lower() in ("article", "main")


class Markup:
    """What the markup of one page leaves out."""

    def __init__(self, root: Node):
        self.root, self._contents = root, None

    def contents(self, node: Node) -> tuple[int, int]:
        """Under the node: the outermost marked articles and main parts, and the characters of text."""
        if self._contents is None:
            found = self._contents = {}
            order = [self.root]
            for n in order:  # grows as it is read: parents before children
                order += [c for c in n.children if isinstance(c, Node)]
            for n in reversed(order):
                marks = size = 0
                for c in n.children:
                    if isinstance(c, str):
                        size += len(c.strip())
                    elif c.tag not in UNSEEN_TAGS:
                        inner, chars = found[id(c)]
                        marks += 1 if marked(c) else inner
                        size += chars
                found[id(n)] = (marks, size)
        return self._contents[id(node)]

    def holds_page(self, node: Node, in_article: bool, sure: bool) -> bool:
        """Whether the node holds what the page is about: all its articles and main parts, or most of its text.
        What the markup is sure of needs both."""
        whole, total = self.contents(self.root)
        marks, size = self.contents(node)
        most = 2 * size > total
        if in_article:
            return most and not sure and not names(node) & COMMENT_WORDS
        every = marks == whole > 0
        return (every and most) if sure else (every or (whole == 0 and most))

    def inside(self) -> set[int]:
        """The ids of the elements within articles and main parts."""
        out: set[int] = set()
        stack = [(self.root, False)]
        while stack:
            n, within = stack.pop()
            for c in n.children:
                if isinstance(c, Node):
                    if within:
                        out.add(id(c))
                    stack.append((c, within or marked(c)))
        return out

    def is_noise(self, node: Node, in_article: bool) -> bool:
        tag, a = node.tag, node.attrs
        if tag in UNSEEN_TAGS:
            return True
        if tag in NOISE_TAGS or (tag == "header" and not in_article):
            return not self.holds_page(node, in_article, tag != "form")
        if not a or tag in ("html", "body", "main", "header"):
            return False
        if tag == "article":
            return bool(names(node) & {"comment", "comments", "reply"})
        if "hidden" in a or re.search(r"display\s*:\s*none", a.get("style", "")):
            return True
        if a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in NOISE_ROLES:
            return not self.holds_page(node, in_article, True)
        if in_article and tag in HEADINGS:
            return False
        found = noise_names(a.get("class", ""))
        if not (in_article and tag in ("section", "p")):
            found |= noise_names(a.get("id", ""))
        own = names(node)
        if found or ("header" in own and not in_article and not own & CONTENT_WORDS):
            return not self.holds_page(node, in_article, False)
        return False


def presentation(node: Node) -> str:
    return f"{node.tag}#{node.attrs.get('id', '')}.{'.'.join(sorted(names(node)))}" if node.attrs else node.tag


def number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def places(root: Node, markup: Markup) -> list[tuple[int, Node, int, int]]:
    """The elements that markup leaves in and statistics may leave out, with the numbers of their place, style and
    content (of the text and elements that markup leaves in).

    Articles, main parts and what holds them are never left out by statistics, nor are headings, table cells and
    inline elements of an article, which belong to the text around them."""
    order: list[tuple[Node, int, bool, int]] = [(root, 0, False, 0)]  # node, place, within an article, style
    at = 0
    while at < len(order):  # parents before children
        n, place, in_article, _ = order[at]
        styles = []
        for c in n.children:
            if isinstance(c, str):
                continue
            own = presentation(c)
            styles.append(own)
            if not markup.is_noise(c, in_article):
                order.append((c, number(f"{place}>{own}"), in_article or marked(c), 0))
        order[at] = (n, place, in_article, number(" ".join(styles)))
        at += 1
    out: list[tuple[int, Node, int, int]] = []
    contents: dict[int, int] = {}
    holding: set[int] = set()
    for n, place, in_article, style in reversed(order):
        parts, holds = [], False
        for c in n.children:
            if isinstance(c, str):
                if held := " ".join(c.split()):
                    parts.append(held)
            elif id(c) in contents:
                holds = holds or id(c) in holding or marked(c)
                if contents[id(c)]:
                    parts.append(str(contents[id(c)]))
        content = contents[id(n)] = number(" ".join(parts)) if parts else 0
        if holds:
            holding.add(id(n))
        part_of_text = in_article and (n.tag in HEADINGS or n.tag in CELLS or n.tag in INLINE)
        if n is not root and not (part_of_text or holds or marked(n) or n.tag in ("html", "body", "br", "hr")):
            out.append((place, n, style, content))
    return out


def page_rows(page: str) -> list[tuple[int, int, int]]:
    """(place, style, content) of the undecided elements of a page."""
    root = parse(page)
    return [(place, style, content) for place, _, style, content in places(root, Markup(root))]


def page_text(page: str | None, low: frozenset[int] = frozenset()) -> str:
    if not page:
        return ""
    root = parse(page)
    markup = Markup(root)
    inside = markup.inside()

    def text(left_out: set[int]) -> str:
        return " ".join(blocks([root], lambda n: id(n) in left_out or markup.is_noise(n, id(n) in inside)))

    left_out = {id(n) for place, n, _, _ in places(root, markup) if place in low} if low else set()
    whole = text(left_out - inside)
    if not left_out & inside:
        return whole
    # where most of an article is on other pages too, it is a copy and no part of the site's frame
    rest = text(left_out)
    return rest if 2 * len(rest) > len(whole) else whole


def style_tree(pages: DataFrame) -> DataFrame:
    """pages (host, html) to one row per host and place: pages, importance."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(host, place, number(page), style, content) for host, page in zip(b["host"], b["html"]) if page for place, style, content in page_rows(page)]
            if out:
                yield pd.DataFrame(out, columns=["host", "place", "page", "style", "content"])

    seen = pages.select("host", "html").mapInPandas(rows, "host string, place long, page long, style long, content long")
    # a page may show a place several times: what it shows there is the sum of the parts
    seen = seen.distinct().groupBy("host", "place", "page").agg(F.sum(F.col("style").cast("decimal(20,0)")).alias("style"), F.sum(F.col("content").cast("decimal(20,0)")).alias("content"))
    # pages are parsed once for both distributions
    shown = seen.select("host", "place", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("shown")) for k in ("style", "content")])).alias("s"))
    counts = shown.groupBy("host", "place", "s.kind", "s.shown").agg(F.count("*").alias("c"))
    of = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value))
    sums = counts.groupBy("host", "place").agg(of("style", F.col("c")).alias("pages"), *[of(k, F.col("c") * F.log("c")).alias(k) for k in ("style", "content")])
    entropy = lambda kind: F.when(F.col("pages") > 1, (F.log("pages") - F.col(kind) / F.col("pages")) / F.log("pages")).otherwise(1.0)
    return sums.select("host", "place", "pages", (STYLE_WEIGHT * entropy("style") + (1 - STYLE_WEIGHT) * entropy("content")).alias("importance"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (url, html, ...) with text and n_chars."""
    hosted = pages.withColumn("__host", url_parts(F.col("url"))[0])
    tree = style_tree(hosted.select(F.col("__host").alias("host"), "html"))
    low = tree.where((F.col("pages") >= MIN_PAGES) & (F.col("importance") < THRESHOLD))
    low = low.groupBy("host").agg(F.collect_set("place").alias("__low")).withColumnRenamed("host", "__host")
    low = written(low, "low")  # its size is looked at before it is used
    rows = low.limit(BROADCAST_ROWS + 1).select("__host", F.size("__low").alias("n")).agg(F.count("*"), F.sum("n")).first()
    if rows[0] <= BROADCAST_ROWS and (rows[1] or 0) <= 10 * BROADCAST_ROWS:
        joined = hosted.join(F.broadcast(low), "__host", "left")
    else:
        joined = salted_join(hosted, low, ["__host"], F.col("html"))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for htmls, lows in batches:
            yield pd.Series([page_text(h, frozenset(x.tolist()) if x is not None else frozenset()) for h, x in zip(htmls, lows)], dtype=object)

    out = joined.withColumn("text", text(F.col("html"), F.col("__low"))).drop("__host", "__low")
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
