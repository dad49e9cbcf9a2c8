"""Main text of pages by a site style tree.

The DOMs of a host's pages are merged: elements that have the same path of tags and presentation attributes are one
node of the host's style tree. A node's presentation importance is the entropy of the layouts (sequences of child tags)
that it has on the host's pages, its content importance that of the texts below it, both as shares of what they could be.
Layout and text that are the same on nearly every page of a host are templates: the branch is removed from each page. Pages
of one main text count once, so copies of a page make nothing a template.

Menus, headers, footers, sidebars, notices, adverts, forms and comments that tell what they are by tag, role or class
have importance zero without counting, as hosts may fill them anew on every page; a name is a whole class or id. The flow of
the article (paragraphs, headings, lists, tables) and what holds the article are never branches to judge.

What is left of the page's articles (or of its main element, or else of its body) is its text: character references
decoded, white space inside a block turned into one space, blocks joined in page order by one line end.

Defined results: null and empty html and pages without text give ""; rows are taken one by one, so repeated rows give
repeated results; a page without a host in its url is judged by its own tags and classes alone; an empty table gives no
rows; other columns are ignored.
"""

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.llm.common import stored

#: Pages, below which a host has no templates; importance below which a branch is one.
MIN_PAGES, THRESHOLD = 8, 0.15

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style noscript template head title iframe object svg canvas audio video select option datalist map".split())
NOISE_TAGS = set("nav header footer aside form button dialog menu textarea fieldset label input".split())
NOISE_ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
#: Whole class names and ids; those that content may have as well (header, promotion, widget) are left to the style tree.
NOISE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs "
    "masthead footer sidebar comment comments commentlist disqus cookie cookies gdpr newsletter subscribe share sharing popup modal pagination pager toolbar "
    "ad-box ad-banner ad-slot ad-container ad-wrapper cookie-notice cookie-banner cookie-bar cookie-consent site-header site-footer site-nav main-nav main-menu "
    "nav-bar nav-menu side-bar comment-list comments-area comment-form share-buttons social-share social-links related-posts related-articles newsletter-signup".split()
)
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol optgroup p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that the style tree judges: containers; and those that it judges outside the article only, as they are its flow, too.
JUDGED = set("div section aside header footer nav form center".split())
JUDGED_OUTSIDE = set("ul ol dl table figure details".split())
#: Opening one of these closes an open paragraph, or an open element of its own kind.
ENDS_P = BLOCKS - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "html", "body"}
ENDS_OWN = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


def is_noise(tag: str, attributes: dict) -> bool:
    """Whether an element says by its tag or role that it is not content."""
    return tag in NOISE_TAGS or (attributes.get("role") or "").lower() in NOISE_ROLES or "hidden" in attributes


def is_named_noise(tag: str, attributes: dict) -> bool:
    """Whether an element has a class or an id that content has not."""
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".lower().replace("_", "-").split()
    if tag == "article":  # readers' comments come as articles, too
        return not {"comment", "reply"}.isdisjoint(names)
    return tag not in ("html", "body", "main") and not NOISE_NAMES.isdisjoint(names)


class Node:
    __slots__ = ("tag", "key", "children", "noise", "named", "main", "judged", "within")

    def __init__(self, tag, key, noise=False, main=False, judged=False, named=False):
        self.tag, self.key, self.noise, self.main, self.judged, self.named = tag, key, noise or named, main, judged, named and not noise
        self.within = main  # an article or main element, or in one
        self.children: list = []  # nodes and strings

    def text(self) -> str:
        """All text below, for comparing contents."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                todo.extend(reversed(x.children))
        return " ".join(" ".join(out).split())


class Page(HTMLParser):
    """The DOM of a page, with unclosed and stray tags settled as browsers do for paragraphs and list items."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#", 0)
        self.open = [self.root]
        self.judged: list[Node] = []
        self.mains: list[Node] = []
        self.above: list[list[Node]] = []  # the elements that each of `mains` is in
        self.feed(html)
        self.close()
        self._settle()

    def _settle(self) -> None:
        """Keep the mains that are not noise or in it; without an article among them, names around the others count for nothing if those say more."""
        seen = [(m, up) for m, up in zip(self.mains, self.above) if not m.noise]
        self.mains = [m for m, up in seen if not any(x.noise for x in up)]
        if len(self.mains) < len(seen) and not any(m.tag == "article" and m.text() for m in self.mains):
            shown, mains = main_text(self, ()), self.mains
            named = [x for _, up in seen if not any(x.noise and not x.named or x.main and x.named for x in up) for x in up if x.named]
            for x in named:
                x.noise = False
            self.mains = [m for m, up in seen if not any(x.noise for x in up)]
            if len(main_text(self, ())) <= len(shown):
                for x in named:
                    x.noise = True
                self.mains = mains
        # a branch that holds the article is never judged
        live = set(map(id, self.mains))
        for m, up in seen:
            if id(m) in live:
                for x in (m, *up):
                    x.judged = False
        self.judged = [n for n in self.judged if n.judged]

    def _close_to(self, k: int) -> None:
        del self.open[k:]

    def _close_open(self, tags: set, within: set) -> None:
        """Close the innermost open element of `tags`, unless one of `within` is between."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return self._close_to(k)
            if self.open[k].tag in within:
                return None

    def handle_starttag(self, tag, attrs):
        from xxhash import xxh64_intdigest

        if tag in ENDS_P:
            self._close_open({"p"}, {"table", "td", "th", "article", "section", "div", "main", "body", "button"})
        if tag in ENDS_OWN:
            self._close_open(ENDS_OWN[tag], {"ul", "ol", "dl", "table", "select"})
        attributes = dict(attrs)
        above = self.open[-1]
        look = f"{tag} {attributes.get('class') or ''} {attributes.get('id') or ''} {attributes.get('role') or ''}"
        main = tag in ("article", "main") or attributes.get("role") == "main"
        judged = tag in JUDGED or tag in JUDGED_OUTSIDE and not above.within
        key = xxh64_intdigest(look.encode("utf-8", "surrogatepass"), above.key)
        node = Node(tag, key, tag in UNSEEN or is_noise(tag, attributes), main, judged, is_named_noise(tag, attributes))
        node.within |= above.within
        above.children.append(node)
        if node.judged:
            self.judged.append(node)
        if node.main:
            self.mains.append(node)
            self.above.append(self.open[1:])
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag not in VOID:
            self._close_open({tag}, set())

    def handle_data(self, data):
        self.open[-1].children.append(data)


def as_signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def branches(page: Page) -> list[tuple[int, int, int]]:
    """(node key, layout, content) of each node of the style tree on a page: of all judged elements that are it and no noise by themselves."""
    from xxhash import xxh64_intdigest

    found: dict[int, tuple[list, list]] = {}
    for node in page.judged:
        if not node.noise:
            tags = [c.tag for c in node.children if not isinstance(c, str)]
            layouts, contents = found.setdefault(node.key, ([], []))
            layouts.append(" ".join(t for k, t in enumerate(tags) if not k or t != tags[k - 1]))
            contents.append(node.text())
    digest = lambda x: as_signed(xxh64_intdigest("\n".join(x).encode("utf-8", "surrogatepass")))
    return [(as_signed(key), digest(layouts), digest(contents)) for key, (layouts, contents) in found.items()]


def main_text(page: Page, templates: frozenset | set) -> str:
    """Blocks of the main text, without noise and without the branches in `templates`."""
    mains = [n for n in page.mains if n.tag == "article"] or page.mains or [page.root]
    blocks, current, inside = [], [], set(map(id, mains))

    def end():
        if line := " ".join("".join(current).split()):
            blocks.append(line)
        current.clear()

    # an explicit stack, as pages nest deeper than Python calls do; entries are (node or string or end of block, seen as main)
    todo = [(page.root, page.mains == [])]
    while todo:
        x, within = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            if within:
                current.append(x)
        elif x.tag == "br" or x.tag == "hr":
            current.append(" ")
        elif not x.noise and not (x.judged and as_signed(x.key) in templates):
            within = within or id(x) in inside
            if x.tag in BLOCKS:
                end()
                todo.append((None, within))
            todo.extend((c, within) for c in reversed(x.children))
    end()
    return "\n".join(blocks)


def host() -> F.Column:
    return F.nullif(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, key, n_pages, importance) of each judged node of each host's merged pages.

    Pages of a host that have one main text count once. Counts are partial aggregates of hashes, so a host that has a third of
    all pages is spread like any other.
    """

    def run(batches):
        from xxhash import xxh64_intdigest

        for batch in batches:
            rows = [[], [], [], [], []]
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html")):
                page = Page(html.as_py())
                if judged := branches(page):
                    text = as_signed(xxh64_intdigest(main_text(page, ()).encode("utf-8", "surrogatepass")))
                    for row in judged:
                        for column, value in zip(rows, (name, text, *row)):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.string(), *[pa.int64()] * 4))], names=["host", "page", "key", "layout", "content"])

    seen = pages.where("host IS NOT NULL AND length(html) > 0").select("host", "html").mapInArrow(run, "host string, page long, key long, layout long, content long")
    once = seen.groupBy("host", "page", "key").agg(F.min(F.struct("layout", "content")).alias("x")).select("host", "key", "x.layout", "x.content")
    entropy = lambda n, x: F.when(n > 1, (F.log(n) - x / n) / F.log(n)).otherwise(1.0)
    parts = []
    counted = once.groupBy("host", "key", "layout", "content").agg(F.count("*").alias("n"))
    for feature in ("layout", "content"):
        each = counted.groupBy("host", "key", feature).agg(F.sum("n").alias("n"))
        parts.append(each.groupBy("host", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("x")).select("host", "key", F.col("n").alias(f"{feature}_n"), entropy(F.col("n"), F.col("x")).alias(feature)))
    both = parts[0].join(parts[1], ["host", "key"])
    return both.select("host", "key", F.col("content_n").alias("n_pages"), F.greatest("layout", "content").alias("importance"))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """(host, keys): the nodes of each host that are templates; as many as its layout has, not as it has pages."""
    low = style_tree(pages).where((F.col("n_pages") >= min_pages) & (F.col("importance") < threshold))
    return low.groupBy("host").agg(F.collect_list("key").alias("keys"))


def extract(pages: DataFrame, min_pages: int = MIN_PAGES, threshold: float = THRESHOLD) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of (page_id, url, html)."""
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host().alias("host"))
    # written, so that Spark knows its size: a small one is sent to the pages, a large one meets them by host, skewed hosts split
    low = stored(templates(pages, min_pages, threshold), "templates")

    def run(batches):
        for batch in batches:
            texts = []
            for html, keys in zip(batch.column("html"), batch.column("keys")):
                texts.append(main_text(Page(html.as_py()), set(keys.as_py() or ())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").cast(pa.int64()), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return pages.join(low, "host", "left").select("page_id", "url", "html", "keys").mapInArrow(run, "page_id long, url string, text string, n_chars long")
