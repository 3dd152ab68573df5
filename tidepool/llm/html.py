"""Main text of web pages, with site templates found by counting element subtrees per host.

1. Every page is parsed into elements.  Subtrees that can be template (see below) are
   hashed, and Spark counts for each host the pages that hold each hash.
2. A hash on at least ``min_pages`` pages is site template if these are ``min_share`` of its host's pages
   or ``many`` at least, so a recurrence counts the same on a large host.  Below ``many`` pages a subtree with more
   than ``LONG`` characters outside links is a shared text, not template.  Pages meet the
   templates by an equi-join on host and hash; nothing is held per host.
3. A page's text is its content root without template subtrees and without elements
   that are no article text by their tag, role, class or id (menus, headers, footers, sidebars,
   notices, adverts, forms, scripts, styles, reader comments).

The content root is all outermost ``article`` elements together if they hold most of the text that is
left, else ``main`` if it does, else the body.  Prose inside an ``article`` or ``main`` (paragraphs,
headings, list items, quotes) is never taken for template, however often it recurs: pages of a host
share lines, passages and whole articles.  Containers inside it may be template; the root and its
ancestors may not.

Words of a class or id that also name content (related-work, notice-period) drop an element only if it
holds little prose outside links; inside a root no heading goes by its class or id.

Text: character references are decoded, white space within a block becomes one space,
blocks are trimmed, empty ones left out, and joined by a line feed in page order.
``br`` is white space.

Defined cases: NULL or empty html gives an empty text; unclosed elements end where HTML says
(a new block ends a paragraph, the end of the page ends everything); a NULL url is a host of
its own; repeated rows are pages of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm.common import materialize, table

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*+)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
SPACE = re.compile(r"\s+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul "
    "caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody table figcaption ul ol dl".split())
SPACED = frozenset("br td th".split())
#: Never article text, by tag.
DROPPED = frozenset(
    "head script style noscript template nav footer aside form button select option textarea input label iframe svg "
    "canvas object embed audio video dialog menu title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Never article text, by a word of the class or id.
WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|adsense|banner|promo\w*|sponsor\w*|sidebar|side-bar|nav|navbar|navigation|menu\w*|"
    r"breadcrumb\w*|masthead|footer|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|"
    r"login|social|share|sharing|related|recommend\w*|comment\w*|disqus|respond|reply|replies|widget\w*|toolbar|pagination|"
    r"pager|skip-link|paywall|copyright)(?:$|[\s_-])", re.I)
#: Of these, words that also name content.
WEAK = re.compile(
    r"(?:^|[\s_-])(?:banner|menu\w*|consent|gdpr|notice\w*|alert|modal|overlay|subscri\w*|signup|login|social|share|sharing|"
    r"related|recommend\w*|widget\w*|copyright)(?=$|[\s_-])", re.I)
#: Characters of prose outside links that keep such an element, in a root and elsewhere.
PROSE_CHARS = {True: 40, False: 200}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Names of layouts, not of their parts (with-sidebar, ad-free).
LAYOUT = re.compile(r"\b(?:with|has|no|without)[_-][\w-]+|\b\w+-free\b", re.I)
PAGE_HEADER = re.compile(r"(?:^|[\s_-])(?:header|topbar|top-bar)(?:$|[\s_-])", re.I)
COMMENTS = re.compile(r"(?:^|[\s_-])(?:comment\w*|reply|replies|disqus)(?:$|[\s_-])", re.I)
ROOTS = frozenset(["article", "main"])
NO_DROP = frozenset(["html", "body"])
SALTS = 64
LONG = 600
SLICE_CHARS = 4_000_000  # markup taken from a batch at once


def slices(batch: pa.RecordBatch, html: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about ``SLICE_CHARS`` bytes of markup (column ``html``), one row at least."""
    import pyarrow.compute as pc
    size = pc.fill_null(pc.binary_length(batch.column(html)), 0).to_pylist()
    at = 0
    while at < len(size):
        stop, total = at + 1, size[at]
        while stop < len(size) and total + size[stop] <= SLICE_CHARS:
            total += size[stop]
            stop += 1
        yield batch.slice(at, stop - at)
        at = stop


class Element:
    __slots__ = ("tag", "start", "end", "parent", "unwanted", "weak", "dropped", "in_root", "items", "index")

    def __init__(self, tag, start, parent, unwanted, in_root, index):
        self.tag, self.start, self.end, self.parent = tag, start, -1, parent
        self.unwanted, self.weak, self.dropped, self.in_root, self.index = unwanted, False, False, in_root, index
        self.items = []  # text segments (str) and child elements


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): _html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(text)}


def is_dropped(tag: str, attrs: str, in_root: bool) -> bool:
    """Whether an element is no article text, by its tag and attributes."""
    if tag in NO_DROP:
        return False
    if tag in DROPPED or (tag == "header" and not in_root):
        return True
    if not attrs.strip():
        return False
    a = attributes(attrs)
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    names = LAYOUT.sub(" ", f"{a.get('class', '')} {a.get('id', '')}")
    if tag in ROOTS:
        return bool(COMMENTS.search(names)) and tag == "article"
    if a.get("role", "").lower() in ROLES:
        return True
    return bool(WORDS.search(names)) or (not in_root and bool(PAGE_HEADER.search(names)))


def is_weak(tag: str, attrs: str, in_root: bool) -> bool:
    """Whether a dropped element is so only by a word that also names content."""
    if not attrs.strip() or tag in DROPPED or tag == "header" or tag in ROOTS or is_dropped(tag, ATTRIBUTE.sub(_no_names, attrs), in_root):
        return False
    a = attributes(attrs)
    names = LAYOUT.sub(" ", f"{a.get('class', '')} {a.get('id', '')}")
    if in_root and tag in HEADINGS:
        return not COMMENTS.search(names)
    rest = WEAK.sub(" ", names)
    return not WORDS.search(rest) and (in_root or not PAGE_HEADER.search(rest))


def _no_names(m: re.Match) -> str:
    return " " if m[1].lower() in ("class", "id") else m[0]


def _keep_prose(elements: list[Element]) -> None:
    """Elements dropped by a weak word stay if they hold prose outside links (headings: any)."""
    if not any(e.weak for e in elements):
        return
    size = [0] * len(elements)
    for e in reversed(elements):  # an element's children come after it
        size[e.index] += sum(len(SPACE.sub(" ", x).strip()) for x in e.items if isinstance(x, str))
        if e.weak and (e.in_root and e.tag in HEADINGS or size[e.index] >= PROSE_CHARS[e.in_root]):
            e.unwanted = False
        if e.parent is not None and e.tag != "a" and not e.unwanted:
            size[e.parent.index] += size[e.index]


def parse(page: str) -> list[Element]:
    """Elements of a page in order; the first is the document."""
    root = Element("#document", 0, None, False, False, 0)
    elements, open_ = [root], [root]
    at = 0

    def close(element: Element, where: int) -> None:
        while True:
            e = open_.pop()
            e.end = where
            if e is element:
                return
    while True:
        m = MARKUP.search(page, at)
        top = open_[-1]
        if m is None:
            if at < len(page):
                top.items.append(page[at:])
            break
        if m.start() > at:
            top.items.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for e in reversed(open_[1:]):
                if e.tag == tag:
                    close(e, at)
                    break
                if e.tag in ROOTS and tag not in BLOCKS:
                    break
            continue
        if tag in BLOCKS or tag in ("td", "th"):
            for e in reversed(open_[1:]):  # a block ends an open paragraph; an item ends its sibling
                if e.tag == "p" and tag in BLOCKS or e.tag == tag and tag in ("li", "td", "th", "tr", "dd", "dt"):
                    close(e, m.start())
                    break
                if e.tag in BLOCKS:
                    break
        top = open_[-1]
        in_root = top.in_root or top.tag in ROOTS
        e = Element(tag, m.start(), top, is_dropped(tag, m[3], in_root), in_root, len(elements))
        e.weak = e.unwanted and is_weak(tag, m[3], in_root)
        elements.append(e)
        top.items.append(e)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            e.end = at
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
            if not e.unwanted:
                e.items.append(page[at:stop.start() if stop else len(page)])
            at = stop.end() if stop else len(page)
            e.end = at
        else:
            open_.append(e)
    for e in open_:
        e.end = len(page)
    _keep_prose(elements)
    for e in elements:  # a form round the article, or anything round main, is layout
        if e.tag in ROOTS and not e.unwanted:
            p = e.parent
            while p is not None:
                if p.tag == "form" or e.tag == "main":
                    p.unwanted = False
                p = p.parent
    for e in elements[1:]:
        e.dropped = e.parent.dropped or e.unwanted
    return elements


def countable(elements: list[Element]) -> Iterator[Element]:
    """Elements whose subtree may be site template: outermost dropped ones, and containers with text of their own or blocks."""
    above_root = set()
    for e in elements:
        if e.tag in ROOTS and not e.dropped:
            while e is not None and e.index not in above_root:
                above_root.add(e.index)
                e = e.parent
    for e in elements[1:]:
        if e.parent.dropped or e.tag in NO_DROP or e.index in above_root or e.tag == "head":
            continue
        if e.dropped or (e.tag in BLOCKS and not (e.in_root and e.tag in PROSE)):
            yield e


def subtree_hash(page: str, e: Element) -> int:
    import xxhash
    return xxhash.xxh64_intdigest(SPACE.sub(" ", page[e.start:e.end]).strip().encode("utf-8", "surrogatepass")) - (1 << 63)


def page_hashes(page: str) -> dict[int, bool]:
    """Hashes of the subtrees of a page that can be template, and whether they are long."""
    elements = parse(page)
    size = [0] * len(elements)
    for e in reversed(elements):  # an element's children come after it
        size[e.index] += sum(len(x) for x in e.items if isinstance(x, str))
        if e.parent is not None and e.tag != "a":
            size[e.parent.index] += size[e.index]
    found = {subtree_hash(page, e): size[e.index] > LONG for e in countable(elements)}
    free(elements)
    return found


def block_texts(e: Element, skip: set[int]) -> list[str]:
    """Texts of the blocks under ``e``, without dropped elements and those in ``skip``."""
    blocks, run = [], []

    def end_block():
        text = SPACE.sub(" ", _html.unescape("".join(run))).strip()
        if text:
            blocks.append(text)
        run.clear()
    stack = [(e, iter(e.items))]
    while stack:
        node, items = stack[-1]
        for x in items:
            if isinstance(x, str):
                run.append(x)
            elif not x.dropped and x.index not in skip:
                if x.tag in BLOCKS:
                    end_block()
                elif x.tag in SPACED:
                    run.append(" ")
                stack.append((x, iter(x.items)))
                break
        else:
            stack.pop()
            if node.tag in BLOCKS:
                end_block()
            elif node.tag in SPACED:
                run.append(" ")
    end_block()
    return blocks


def free(elements: list[Element]) -> None:
    """Cuts the circles of parents and children, so the page goes at once and not when the collector runs."""
    for e in elements:
        e.parent = None
        e.items.clear()


def main_text(page: str, template: set[int]) -> str:
    """Text of the content root without the subtrees whose hashes are in ``template``."""
    if not page:
        return ""
    elements = parse(page)
    try:
        return _root_text(page, elements, template)
    finally:
        free(elements)


def _root_text(page: str, elements: list[Element], template: set[int]) -> str:
    skip = {e.index for e in countable(elements) if subtree_hash(page, e) in template} if template else set()
    hidden = set()
    for e in elements:
        if e.index in skip or (e.parent is not None and e.parent.index in hidden):
            hidden.add(e.index)
    whole = block_texts(elements[0], skip)
    most = sum(map(len, whole)) / 2
    for tag in ("article", "main"):
        blocks = []
        for e in elements:
            if e.tag == tag and not e.dropped and e.index not in hidden and not _inside(e, tag):
                blocks += block_texts(e, skip)
        if blocks and sum(map(len, blocks)) >= most:
            return "\n".join(blocks)
    return "\n".join(whole)


def _inside(e: Element, tag: str) -> bool:
    p = e.parent
    while p is not None:
        if p.tag == tag:
            return True
        p = p.parent
    return False


# ----------------------------------------------------------------------- Spark

def host_of(url: str) -> Column:
    h = F.lower(F.regexp_extract(F.col(url), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.coalesce(h, F.lit(""))


def subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: (k1, k2, host, html) to (k1, k2, host, hashes, long)."""
    for b in (part for batch in batches for part in slices(batch, 3)):
        found = [page_hashes(p or "") for p in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), b.column(2), pa.array([list(x) for x in found], pa.list_(pa.int64())),
             pa.array([list(x.values()) for x in found], pa.list_(pa.bool_()))], ["k1", "k2", "host", "hashes", "long"])


def page_templates(rows: DataFrame, min_pages: int, min_share: float, many: int) -> DataFrame:
    """(k1, k2, template): of every page (k1, k2, host, html) with any, the hashes that are template of its host."""
    pages = materialize(rows.select("k1", "k2", "host", "html").mapInArrow(
        subtrees, "k1 long, k2 long, host string, hashes array<long>, long array<boolean>"), "html-subtrees")
    sizes = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = pages.select("host", F.explode(F.arrays_zip("hashes", "long")).alias("s")) \
        .groupBy("host", F.col("s.hashes").alias("hash")).agg(F.count(F.lit(1)).alias("n"), F.max("s.long").alias("long"))
    sites = each.where(F.col("n") >= min_pages).join(sizes, "host") \
        .where((F.col("n") >= many) | (F.col("n") >= min_share * F.col("pages")) & ~F.col("long")) \
        .select(F.col("host").alias("_host"), F.col("hash").alias("_hash"))
    # a template may be on a third of all pages: they are dealt out by salt, it is copied to every salt
    sites = sites.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = pages.groupBy("k1", "k2").agg(F.first("host").alias("host"), F.first("hashes").alias("hashes")) \
        .select("k1", "k2", "host", F.explode("hashes").alias("hash")).withColumn("salt", F.pmod("k1", F.lit(SALTS)))
    met = own.join(sites, (F.col("host") == F.col("_host")) & (F.col("hash") == F.col("_hash")) & (F.col("salt") == F.col("_salt")))
    return met.groupBy("k1", "k2").agg(F.collect_list("hash").alias("template"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                      min_pages: int = 3, min_share: float = 0.05, many: int = 10) -> DataFrame:
    """(page_id, url, text) of every page."""
    host = host_of(url_col)
    parts = (F.coalesce(F.col(html_col), F.lit("")), host)  # pages of a host with equal html have equal texts
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
                        host.alias("host"), F.xxhash64(*parts).alias("k1"), F.xxhash64(F.lit("second"), *parts).alias("k2"))
    sites = page_templates(rows, min_pages, min_share, many).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    joined = rows.join(sites, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left") \
        .select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for batch in batches for part in slices(batch, 2)):
            texts = [main_text(p or "", set(t or ())) for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return joined.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")


def op1_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = extract_main_text(table(spark, sf_dir, "pages"))
    return t.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
