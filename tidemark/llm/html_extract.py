"""Main text of web pages: site template removal by subtree frequency, and page furniture by its markup.

Every element subtree is hashed (tag, the text inside and its child subtrees). Spark counts for each host on how many
of its pages a subtree occurs, furniture or not, and a second pass deletes subtrees that recur on at least ``MIN_PAGES``
pages and on ``MIN_SHARE`` of the host's pages, inside articles too. If the page has an article or a main element that holds text,
only what lies in it is kept. As the article of a page copied on many urls is still its text, pages of one host with
equal articles count as one page, and the article itself is never a template.

What doesn't recur goes by its markup, on any host: elements that are furniture by tag or role (nav, header, footer,
aside, form, script, ...; a header with a heading inside an article is the article's own) or hidden; and elements whose
class or id names furniture (menu, sidebar, cookie, advert, comments, ...). Names are the weaker sign: they don't count
on what holds an article or main element or, but for comments and cookie notices, more than half of the page's text, nor
if they only say what a layout has (has-sidebar, social-page), name a part of the text (post-header) or begin a phrase
(menu-of-the-day, ad-hoc); of paragraphs and headings, only names of adverts, notices and comments do. Articles named as comments, or nested in an article with text of its own, go.

Text: character references are decoded; white space inside a block becomes one space; blocks (block-level elements
and line breaks) are trimmed and joined in page order by one \\n; empty ones are left out.

The parser is a tolerant tokeniser with implied end tags: unclosed inline elements end with their block, p ends at the
next block, li, td, option and their like at the next of their kind, and stray end tags are ignored.

Defined results: a null or empty html gives an empty text and n_chars 0; a null url is a host of its own. Rows with a
repeated page_id, or equal rows, are pages of their own in the result, and in the counts if they have no article. Very
long pages are taken whole. No rows give no rows; other columns, of whatever name, are ignored.
"""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import read_table
from .url_filter import split_url

MIN_PAGES = 5
MIN_SHARE = 0.3
CHUNK = 4 << 20
#: 64-bit keys of templates, over all hosts, up to which they are broadcast.
MAX_BROADCAST_KEYS = 2_000_000

RAW = {"script", "style", "textarea", "title", "xmp", "noembed", "noframes", "iframe"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
FURNITURE = set("nav header footer aside form script style head noscript template iframe button select input textarea dialog menu svg canvas object video audio map title".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
COMMENT_WORDS = set("comment comments disqus reply replies respond".split())
#: Names that count on paragraphs and headings too.
NOTICE_WORDS = COMMENT_WORDS | set(
    "cookie cookies consent gdpr notice newsletter subscribe subscription signup ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion share sharing".split()
)
FURNITURE_WORDS = NOTICE_WORDS | set(
    "nav navbar navigation menu sidebar footer header masthead breadcrumb breadcrumbs banner alert popup modal overlay login related recommended recommendations social widget "
    "pagination pager toolbar skip search".split()
)
#: Names that begin or end like this describe a layout; a header or a relation of the text is part of the text.
LAYOUT_FIRST, LAYOUT_LAST = {"has", "no", "with", "without"}, {"page", "layout", "site", "app"}
TEXT_PARTS = {"post", "entry", "article", "story", "content", "section", "work", "works", "study", "studies"}
#: A name of one of the first and else only of these and FURNITURE_WORDS is a notice however long it is.
CONSENT_WORDS, CONSENT_PARTS = {"cookie", "cookies", "consent", "gdpr"}, {"bar", "box", "wrapper", "container", "dialog"}
#: A word before one of these doesn't name the element.
PHRASES = {"of", "hoc"}
LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "b", "i", "em", "strong", "span", "a", "blockquote", "pre", "td", "th", "li"}
HARD, NAMED, COMMENTS = 3, 1, 2
#: An open element of the first kind ends where one of the second starts.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option", "optgroup"}, "optgroup": {"optgroup"},
    "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
    "thead": {"tbody", "tfoot"}, "tbody": {"tbody", "tfoot"},
}
#: Implied ends don't look beyond these.
SCOPE = {"ul", "ol", "dl", "table", "select", "div", "article", "section", "main", "body", "html", "aside", "nav", "td", "th"}
ENDS_P = BLOCK - {"br", "body", "html", "head", "option", "optgroup", "legend", "td", "th", "tr", "tbody", "thead", "tfoot"}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "children", "furniture", "key", "has_text", "size", "holds")

    def __init__(self, tag: str, furniture: int = 0):
        self.tag, self.furniture, self.children, self.key, self.has_text, self.size, self.holds = tag, furniture, [], 0, False, 0, False


def named_furniture(tag: str, names: str) -> int:
    """What the words of a class or id say."""
    found = 0
    for name in names.split():
        words = WORDS.findall(name)
        if not words or words[0] in LAYOUT_FIRST or words[-1] in LAYOUT_LAST:
            continue
        signs = FURNITURE_WORDS.intersection(w for w, after in zip(words, [*words[1:], ""]) if after not in PHRASES)
        if not COMMENT_WORDS.isdisjoint(signs):
            return COMMENTS
        if tag not in ("article", "main") and not CONSENT_WORDS.isdisjoint(signs) and words not in (["cookie"], ["cookies"]) and FURNITURE_WORDS.union(CONSENT_PARTS).issuperset(words):
            return COMMENTS
        if signs <= {"header", "related", "search"} and not TEXT_PARTS.isdisjoint(words):
            continue
        if signs if tag not in LEAVES else not NOTICE_WORDS.isdisjoint(signs):
            found = NAMED
    return found


def furniture_of(tag: str, attributes: str) -> int:
    """HARD by tag, role or hiding; COMMENTS or NAMED by class or id; else 0."""
    if tag in FURNITURE:
        return HARD
    if tag in ("html", "body") or not attributes or attributes.isspace():
        return 0
    found = 0
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), html_lib.unescape(a or b or c).lower()
        if tag not in ("article", "main") and (name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.strip() in ROLES)):
            return HARD
        if tag not in ("article", "main") and name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return HARD
        if name in ("class", "id"):
            found = max(found, named_furniture(tag, value))
    if tag in ("article", "main"):
        return HARD if tag == "article" and found == COMMENTS else 0
    return found


def parse(source: str) -> Node:
    """The page's tree; text nodes are str children, with character references decoded."""
    root = Node("#root")
    stack = [root]
    at = 0

    def text(chunk: str) -> None:
        if chunk:
            stack[-1].children.append(html_lib.unescape(chunk) if "&" in chunk else chunk)

    def close(depth: int) -> None:
        del stack[depth:]

    while True:
        found = TOKEN.search(source, at)
        if not found:
            text(source[at:])
            break
        text(source[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            else:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == tag:
                        close(depth)
                        break
                    if stack[depth].tag in SCOPE and tag not in SCOPE and tag not in BLOCK:
                        break  # a stray inline end tag doesn't close a block
            continue
        if tag in BLOCK:
            if tag in ENDS_P:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].tag == "p":
                        close(depth)
                        break
                    if stack[depth].tag in SCOPE:
                        break
            for depth in range(len(stack) - 1, 0, -1):
                if tag in ENDS.get(stack[depth].tag, ()):
                    close(depth)
                elif stack[depth].tag in SCOPE and stack[depth].tag not in ENDS:
                    break
        node = Node(tag, furniture_of(tag, found[3]))
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|</{re.escape(tag)}\Z", re.I).search(source, at)
            inside = source[at : end.start() if end else len(source)]
            if inside and tag in ("title", "textarea"):
                inside = html_lib.unescape(inside)
            node.children.append(inside)
            at = end.end() if end else len(source)
        elif tag not in VOID and not found[3].endswith("/"):
            stack.append(node)
        elif tag not in VOID and tag not in ("svg", "path", "circle", "rect", "use"):
            stack.append(node)  # a slash doesn't close an html element
    return root


def postorder(root: Node) -> list[Node]:
    """All elements, children before parents; no recursion, as pages can nest deeply."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.children if isinstance(x, Node))
    order.reverse()
    return order


def hash_tree(root: Node) -> list[Node]:
    """All elements with the hashes and sizes of their subtrees; signs of furniture that don't hold are taken back."""
    order = postorder(root)
    for node in order:
        digest = xxhash.xxh3_64(node.tag.encode())
        for child in node.children:
            if isinstance(child, Node):
                digest.update(child.key.to_bytes(8, "little", signed=True))
                node.has_text |= child.has_text
                node.size += 0 if child.furniture == HARD else child.size
                node.holds |= child.furniture != HARD and (child.holds or (child.tag in ("article", "main") and child.has_text))
            elif plain := SPACES.sub(" ", child).strip():
                digest.update(plain.encode("utf-8", "surrogatepass"))
                node.has_text = True
                node.size += len(plain)
        node.key = digest.intdigest() - (1 << 63)
    for node in order:
        if node.furniture == NAMED and (node.holds or 2 * node.size > root.size) or node.furniture == COMMENTS and node.holds:
            node.furniture = 0
    for node in order:
        if node.tag == "article":
            _keep_headers(node)
    return order


def _keep_headers(article: Node) -> None:
    """A header in an article is the article's own if it has a heading."""
    for child in article.children:
        if isinstance(child, Node) and child.tag == "header" and any(x.tag in ("h1", "h2", "h3") for x in postorder(child)):
            child.furniture = 0


def regions(root: Node) -> list[Node]:
    """Outermost article or main elements with text outside furniture; none: the whole page."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.furniture or not node.has_text:
            continue
        if node.tag == "article" or (node.tag == "main" and not _holds_article(node)):
            found.append(node)
        else:
            todo.extend(x for x in reversed(node.children) if isinstance(x, Node))
    return found


def _holds_article(node: Node) -> bool:
    todo = list(node.children)
    while todo:
        x = todo.pop()
        if isinstance(x, Node) and not x.furniture:
            if x.tag == "article" and x.has_text:
                return True
            todo.extend(x.children)
    return False


def _has_own_text(article: Node) -> bool:
    """Whether the article has paragraphs or bare text outside nested articles."""
    todo: list = [(article, False)]
    while todo:
        node, inside = todo.pop()
        for x in node.children:
            if isinstance(x, str):
                if inside and x.strip():
                    return True
            elif not x.furniture and x.tag != "article":
                todo.append((x, inside or x.tag in ("p", "div", "section", "ul", "ol", "table", "blockquote", "pre")))
    return False


def render(nodes: list[Node], templates: set[int]) -> str:
    """Text of the given subtrees without furniture and templates; the given roots themselves always stay."""
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if plain := SPACES.sub(" ", "".join(line)).strip():
            blocks.append(plain)
        line.clear()

    for top in nodes:
        todo: list = [top]
        nested = top.tag == "article" and _has_own_text(top)
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif isinstance(x, str):
                line.append(x)
            elif x is top or not (x.furniture or (nested and x.tag == "article") or x.key in templates):
                if x.tag in BLOCK:
                    flush()
                    todo.append(None)
                todo.extend(reversed(x.children))
        flush()
    return "\n".join(blocks)


def candidates(source: str | None) -> tuple[list[int], int | None]:
    """Keys of the page's element subtrees that could be a template (with text, below the body, not the article itself,
    furniture or not), in order, and a hash of its article, if it has one."""
    if not source:
        return [], None
    root = parse(source)
    order = hash_tree(root)
    main = regions(root)
    roots = {id(n) for n in main}
    keys = {n.key for n in order if n.has_text and n.tag not in ("#root", "html", "body", "head") and id(n) not in roots}
    article = xxhash.xxh3_64_intdigest(b"".join(n.key.to_bytes(8, "little", signed=True) for n in main)) - (1 << 63) if main else None
    return sorted(keys), article


def extract(source: str | None, templates: set[int]) -> str:
    if not source:
        return ""
    root = parse(source)
    hash_tree(root)
    return render(regions(root) or [root], templates)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in common.slices(batches, 1, CHUNK):
        hosts = [u and split_url(u)[0] for u in batch.column(0).to_pylist()]
        found = [candidates(h) for h in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array([a for _, a in found], pa.int64()), pa.array([k for k, _ in found], pa.list_(pa.int64()))], ["host", "article", "keys"])


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, key) of subtrees that recur across a host's pages. Counts are combined before the shuffle."""
    found = common.cut_lineage(pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(_keys, "host string, article bigint, keys array<bigint>"))
    # Of the pages with one article, the one of the least keys counts.
    copies = found.where(F.col("article").isNotNull()).groupBy("host", "article").agg(F.min("keys").alias("keys"))
    seen = common.cut_lineage(found.where(F.col("article").isNull()).select("host", "keys").union(copies.select("host", "keys")))
    sizes = seen.groupBy("host").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    counts = seen.select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    return counts.join(sizes.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).where(F.col("n") >= min_share * F.col("pages")).select("host", "key")


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars."""
    picked = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    # The templates of a host are at most 1 / MIN_SHARE pages' worth of subtrees, so a row stays small.
    by_host = common.cut_lineage(site_templates(pages, url_col, html_col).groupBy("host").agg(F.collect_set("key").alias("templates")))
    if by_host.agg(F.coalesce(F.sum(F.size("templates") + 8), F.lit(0))).first()[0] <= MAX_BROADCAST_KEYS:
        by_host = F.broadcast(by_host)  # else pages are shuffled by host, and a host with most rows is split as skewed
    host = F.when(F.col("url").isNotNull(), F.coalesce(F.translate(F.regexp_extract("url", "(?s)://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")))
    joined = picked.withColumn("h", host).join(by_host, F.col("h").eqNullSafe(F.col("host")), "left").select("id", "url", "html", "templates")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 2, CHUNK):
            texts = [extract(h, set(t or ())) for h, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in picked.schema}
    return joined.mapInArrow(scan, f"`{id_col}` {kinds['id']}, `{url_col}` {kinds['url']}, text string, n_chars bigint")


def query(spark, sf_dir):
    return extract_pages(read_table(spark, sf_dir, "pages"))
