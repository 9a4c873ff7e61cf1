"""Main text of web pages, with a site style tree over the pages of each host.

Each page is parsed into blocks of text, each with the chain of elements it stands in. The pages of a
host are merged into one tree whose nodes are element paths with their classes; for each node the
pages' styles (the template of the branch: its elements, where a run of equal ones is one, however
long) and contents (the text below it) are counted. Pages of equal article text count once, so copies
have no weight. The entropy of either distribution, as a share of its largest possible value, is 0 for
a branch that is the same on every page and 1 for one that differs on each page; it is smoothed with
PRIOR pages that speak for the branch, so that a few pages are little evidence. A branch goes for its

- importance, the two together: under LOW_IMPORTANCE it looks and reads the same on all pages;
- presentation alone, whatever it says: under LOW_IMPORTANCE, where a sibling's is RICHER times as
  much or more and the branch holds no paragraph, heading, quotation or preformatted text. So a menu of
  other links on each page, or an advert of other words, is one template beside an article that has many.

What is in the article element, and paragraphs and headings of main, stays whatever the entropy, which
groups of near copies would else take down. What the tree leaves is then judged by what the page itself
says (tag, role, class or id): for hosts of few pages, and for comments and forms within articles.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvana.llm.batches import mapper
from corvana.session import cut

LOW_IMPORTANCE, RICHER, PRIOR = 0.2, 4, 2.0
PRESENTATION_SHARE = 0.3
#: Low branches of all hosts that are broadcast (16 bytes each); more of them meet the pages by host and salt.
BROADCAST_PATHS, SALTS = 500_000, 64

# Elements without content, with raw text, that close themselves, and that break lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tbody", "thead"}, "tbody": {"tbody", "thead"},
}
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
SCOPES = frozenset("html body table ul ol dl article section main div nav aside header footer form".split())
DROP_TAGS = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form frameset head iframe input map menu nav noembed noframes noscript object script select style svg template textarea title video".split()
)
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROP_NAMES = frozenset(
    "ad ads adslot advert advertisement adverts banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo promoted promotion reader-comments related replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Compounds of these words that name chrome; - and _ are the same.
DROP_COMPOUNDS = frozenset(
    "ad-banner ad-box ad-container ad-slot ad-unit ad-wrapper article-share breadcrumb-nav comment-form comment-list comment-respond comments-area comments-list comments-section consent-banner cookie-banner cookie-bar cookie-consent cookie-message cookie-notice cookie-popup footer-links footer-menu footer-nav footer-widgets gdpr-banner google-ad left-sidebar login-form main-menu main-nav main-navigation menu-main mobile-menu mobile-nav modal-dialog nav-bar nav-links nav-menu newsletter-form newsletter-signup page-footer page-nav popup-overlay post-comments post-navigation primary-menu primary-nav primary-navigation related-articles related-links related-posts related-stories right-sidebar search-form share-bar share-buttons share-links sharing-buttons side-bar sidebar-left sidebar-right signup-form site-footer site-nav site-navigation skip-link social-bar social-buttons social-icons social-links social-share sponsored-content sub-menu subscribe-form top-menu top-nav user-menu widget-area".split()
)
#: Words that are as often a section's anchor or an aside of the author: as an id in an article they say nothing, nor the last ones as a class.
WEAK_IDS = frozenset("ad ads comment consent cookie cookies footer gdpr login menu modal navigation newsletter overlay pagination popup promotion related replies respond share sharing sidebar signup social sponsor subscribe toolbar widget banner".split())
WEAK = frozenset("notice banner footer".split())
HEADER_NAMES = frozenset("header site-header page-header topbar".split())
KEPT = frozenset("html body article main".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
PLAIN = PROSE | INLINE

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+(?:>|\Z)", re.DOTALL)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
NAME_PARTS = re.compile(r"[\s]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


class Node:
    """An element of a page. key: the hash of its path; items: hashes of its own blocks and its children, in order; kinds: its children, by name where they hold nothing."""

    __slots__ = ("tag", "name", "parent", "key", "dropped", "hard", "rescued", "article", "plain", "kinds", "items")

    def __init__(self, tag: str, parent: Node | None, name: str, hard: bool, named: bool = False):
        self.tag, self.name = tag, name
        self.parent = parent
        self.key = number(f"{parent.key if parent else ''}/{name}")
        self.hard = hard or (parent is not None and parent.hard)
        inside = parent.article if parent else 0
        level = 2 if tag == "article" else 1 if tag == "main" else 0
        self.rescued = parent.rescued if parent else 0  # 1: a name alone dropped what article or main stand in; 2: and that stands in main
        self.dropped = self.hard or named or (parent is not None and parent.dropped)
        if self.dropped and not self.hard and level > inside:
            self.dropped, self.rescued = False, 1 + inside
        self.article = max(inside, 0 if self.dropped else level)
        self.plain = tag in KEPT or (bool(inside) and tag in PLAIN and parent.plain)
        self.kinds: list[str | Node] = []
        self.items: list[int | Node] = []


def names_chrome(kind: str, words: list[str], tag: str, in_article: bool) -> bool:
    """Whether whole words of a class or id, or fixed compounds, name something that is no article text."""
    found = {w.replace("_", "-") for w in words}
    if in_article and (kind == "id" or found & WEAK):
        if kind == "id" and tag in PLAIN:
            return False
        found -= WEAK | WEAK_IDS if kind == "id" else WEAK
    return not (found.isdisjoint(DROP_NAMES) and found.isdisjoint(DROP_COMPOUNDS)) or not in_article and not found.isdisjoint(HEADER_NAMES)


def described(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """The node's name in the tree; whether tag, role or hidden, and whether class or id say that it holds no article text."""
    hard, named, names = tag in DROP_TAGS or tag == "header" and not in_article, False, ""
    if attributes and tag not in KEPT:
        for m in ATTRIBUTE.finditer(attributes):
            kind, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if kind == "hidden":
                hard = True
            elif kind == "role":
                hard |= value in DROP_ROLES
            elif value:
                whole = NAME_PARTS.split(value.strip())
                named |= names_chrome(kind, whole, tag, in_article)
                if kind == "class":
                    names = "." + ".".join(sorted(whole))
    return tag + names, hard, named


def parse(page: str | None) -> tuple[list[tuple[Node, str]], list[Node]]:
    """The page's blocks (innermost node, text) in order, and all its nodes; each text of a dropped node is a block."""
    root = Node("", None, "", False)
    stack, nodes, blocks, held = [root], [root], [], []
    opened: Counter[str] = Counter()  # tags in the stack
    home = root

    def leave(n: int) -> None:
        opened.subtract(node.tag for node in stack[n:])
        del stack[n:]

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                blocks.append((home, text))
                home.items.append(number(text))

    page, at = page or "", 0
    while True:
        m = TAG.search(page, at)
        end = m.start() if m else len(page)
        if end > at and stack[-1].dropped:
            text = " ".join(entities.unescape(page[at:end]).split())
            if text:
                blocks.append((stack[-1], text))
                stack[-1].items.append(number(text))
        elif end > at:
            if not held:
                home = stack[-1]
            held.append(page[at:end])
        if m is None:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if tag not in INLINE:
            flush()
        elif tag == "br" and held:
            held.append(" ")
        if m[1]:
            for n in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[n].tag == tag:
                    if stack[n].dropped and not stack[n - 1].dropped:
                        flush()
                    leave(n)
                    break
                if stack[n].tag in SCOPES and tag in INLINE:
                    break
            continue
        closes = CLOSES.get(tag)
        if (closes or tag not in INLINE) and (opened["p"] or closes and any(opened[c] for c in closes)):
            for n in range(len(stack) - 1, 0, -1):
                open_tag = stack[n].tag
                if open_tag in SCOPES:
                    break
                if open_tag == "p" or closes and open_tag in closes:
                    leave(n)
                    if open_tag == "p":
                        break
        name, hard, named = described(tag, m[3], bool(stack[-1].article))
        parent = stack[-1]
        if tag in VOID:
            parent.kinds.append(name)
            continue
        node = Node(tag, parent, name, hard, named)
        parent.kinds.append(node)
        nodes.append(node)
        parent.items.append(node)
        if tag in RAW:
            close = re.compile(f"</{tag}(?=[\\s/>])|\\Z", re.IGNORECASE).search(page, at)
            after = page.find(">", close.start())
            at = len(page) if after < 0 else after + 1
            continue
        if not m[3].endswith("/") or tag in KEPT:
            stack.append(node)
            opened[tag] += 1
    flush()
    return blocks, nodes


def number(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def collapsed(values: list) -> list:
    """The values, of a run of equal ones the first."""
    return [x for n, x in enumerate(values) if not n or x != values[n - 1]]


def tree_rows(page: str | None) -> tuple[int, list[tuple[int, int, int, int, bool]]]:
    """A digest of the page's article text; for each node path outside articles, and for articles themselves, (path, its parent's, kind, value, whether prose is in it).

    Kind 0 is the template of its branches, 1 the text below them.
    """
    blocks, nodes = parse(page)
    digests: dict[int, int | None] = {}
    template: dict[int, int] = {}
    prose: set[int] = set()
    for node in reversed(nodes):  # children before their parents
        found = [digests[id(x)] if isinstance(x, Node) else x for x in node.items]
        found = [x for x in found if x is not None]
        digests[id(node)] = number(repr(found)) if found else None
        template[id(node)] = number(repr((node.name, collapsed([template[id(x)] if isinstance(x, Node) else x for x in node.kinds]))))
        if node.parent is not None and (node.tag in PROSE or id(node) in prose):
            prose.update((id(node), id(node.parent)))
    styles: dict[int, list[int]] = {}
    texts: dict[int, list[int]] = {}
    parents: dict[int, int] = {}
    inside: set[int] = set()
    holding: set[int] = set()
    for node in nodes[1:]:
        styles.setdefault(node.key, []).append(template[id(node)])
        own = texts.setdefault(node.key, [])
        parents[node.key] = node.parent.key
        if digests[id(node)] is not None:
            own.append(digests[id(node)])
        if node.parent.article == 2:
            inside.add(node.key)
        if id(node) in prose:
            holding.add(node.key)
    rows = []
    for key, own in styles.items():
        if key not in inside:
            values = number(repr(collapsed(own))), number(repr(texts[key]))
            rows += [(key, parents[key], kind, value, key in holding) for kind, value in enumerate(values)]
    return number("\n".join(text for _, text in article_blocks(unmarked(blocks)))), rows


def unmarked(blocks: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """The blocks that don't stand in what the page itself marks as no article text."""
    return [x for x in blocks if not x[0].dropped]


def article_blocks(blocks: list[tuple[Node, str]]) -> list[tuple[Node, str]]:
    """The blocks of articles; of main, where more of its text stands outside its articles than in them or it has none; else all.

    Articles that stand in an element with a name of chrome (as comments do) count only where there
    is no other, and no longer text outside them.
    """
    own = [x for x in blocks if x[0].article and not x[0].rescued]
    if own:
        whole = any(node.article == 2 for node, _ in own)
        blocks = [x for x in blocks if not x[0].rescued or x[0].rescued == 2 and not whole]
    else:
        rest = [x for x in blocks if not x[0].article]
        if sum(len(text) for _, text in rest) > sum(len(text) for node, text in blocks if node.article):
            return rest
    size = [sum(len(text) for node, text in blocks if node.article == level) for level in range(3)]
    if size[1] > size[2]:
        return [x for x in blocks if x[0].article]
    best = 2 if size[2] else 0
    return [x for x in blocks if x[0].article == best]


def main_text(page: str | None, low: set[int] | frozenset[int] | None = None, marks: bool = True) -> str:
    """The page's article blocks joined by line feeds; low: hashes of the paths whose branches go; without marks nothing but these decides."""
    blocks, nodes = parse(page)
    if low:
        gone: dict[int, bool] = {}
        for node in nodes:  # parents before their children
            gone[id(node)] = node.parent is not None and gone[id(node.parent)] or node.tag not in KEPT and node.key in low
        blocks = [(node, text) for node, text in blocks if node.article == 2 or node.plain or not gone[id(node)]]
    return "\n".join(text for _, text in (article_blocks(unmarked(blocks)) if marks else blocks))


ROW_TYPES = [("path", pa.int64()), ("parent", pa.int64()), ("kind", pa.int32()), ("value", pa.int64()), ("prose", pa.bool_())]
TREE_SCHEMA = pa.schema([("host", pa.string()), ("page", pa.int64()), ("rows", pa.list_(pa.struct(ROW_TYPES)))])


def style_tree(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """(host, path, parent, importance, presentation, prose, n_pages) of each node outside articles, and of articles, of each host's merged tree.

    Of pages with equal article text one counts, that of the least tree.
    """

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = {}
        for h, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            digest, rows = tree_rows(page)
            found[h, digest] = min(rows, found.get((h, digest), rows))
        hosts, digests = [h for h, _ in found], [d for _, d in found]
        names = [name for name, _ in ROW_TYPES]
        rows = [[dict(zip(names, row, strict=True)) for row in own] for own in found.values()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((hosts, digests, rows), TREE_SCHEMA.types, strict=True)], schema=TREE_SCHEMA)

    rows = pages.select(F.col(host).alias("host"), F.col(html).alias("html")).mapInArrow(mapper(kernel, "html"), "host string, page long, rows array<struct<path:long,parent:long,kind:int,value:long,prose:boolean>>")
    distinct = rows.groupBy("host", "page").agg(F.min("rows").alias("rows"))
    values = distinct.select("host", F.explode("rows").alias("r")).select("host", "r.*").groupBy("host", "path", "parent", "kind", "value").agg(F.count("*").alias("n"), F.max("prose").alias("prose"))
    sums = values.groupBy("host", "path", "parent", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.max("prose").alias("prose"))
    entropy = F.when(F.col("m") > 1, (F.log("m") - F.col("nlogn") / F.col("m")) / F.log("m")).otherwise(1.0)
    smoothed = (entropy * F.col("m") + PRIOR) / (F.col("m") + PRIOR)
    of_kind = lambda kind: F.max(F.when(F.col("kind") == kind, smoothed))
    found = sums.groupBy("host", "path", "parent").agg(of_kind(0).alias("presentation"), of_kind(1).alias("content"), F.max("prose").alias("prose"), F.max("m").alias("n_pages"))
    importance = PRESENTATION_SHARE * F.col("presentation") + (1 - PRESENTATION_SHARE) * F.col("content")
    return found.select("host", "path", "parent", importance.alias("importance"), "presentation", "prose", "n_pages")


def low_branches(tree: DataFrame) -> DataFrame:
    """(host, path) of the branches of style_tree() that go, for their importance or for their presentation beside a sibling's."""
    richest = tree.groupBy("host", "parent").agg(F.max("presentation").alias("richest"))
    one_template = (F.col("presentation") < LOW_IMPORTANCE) & ~F.col("prose") & (F.col("richest") >= RICHER * F.col("presentation"))
    return tree.join(richest, ["host", "parent"]).where((F.col("importance") < LOW_IMPORTANCE) | one_template).select("host", "path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_paths: int = BROADCAST_PATHS, marks: bool = True) -> DataFrame:
    """(id_col, url_col, text) of every page, from its whole HTML.

    A null page has an empty text; a null or odd url makes a host of its own, the empty one. Low
    branches of the host's style tree go first; a host's few pages are weak evidence, so of under
    nine none goes. Of the rest, pages with an article element give the text of their articles, else
    that of main, else of the body; main with its articles where these are less than half of it;
    without what the page itself marks as chrome. With marks off, the tree alone decides.
    Character references are decoded, white space within a block becomes one blank, blocks are
    joined by line feeds in page order; br is white space. Repeated rows and null ids are kept. Only
    the three columns are read.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), HOST, 1), F.lit("")))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))
    low = cut(low_branches(cut(style_tree(rows))))
    if low.count() <= broadcast_paths:  # once to each worker, not with each page
        by_host: dict[str, set[int]] = {}
        for r in low.collect():
            by_host.setdefault(r["host"], set()).add(r["path"])
        shared = rows.sparkSession.sparkContext.broadcast(by_host)
        matched, low_of = rows.select("id", "url", "html", "host"), lambda batch, n: shared.value.get(batch.column("host")[n].as_py())
    else:
        of_host = low.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("low"))  # a low path needs several pages, so a host's are far fewer than its pages
        salted = of_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        matched = rows.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").select("id", "url", "html", "low")
        low_of = lambda batch, n: set(batch.column("low")[n].as_py() or ())
    schema = pa.schema([("text", pa.string())])

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(page, low_of(batch, n), marks) for n, page in enumerate(batch.column("html").to_pylist())]
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, schema.field(0).type)], names=["id", "url", "text"])

    id_type = rows.schema["id"].dataType.simpleString()
    found = matched.mapInArrow(mapper(kernel, "html"), f"id {id_type}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
