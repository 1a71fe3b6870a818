"""Main text of web pages by site template removal.

Every page is parsed into elements. The subtrees of its structural elements are hashed (tag, class, id and everything within);
Spark counts on how many different page bodies of a host each hash stands, exact copies of a page counting once, and subtrees
that recur on ``least_pages`` of a host's bodies are the site's template and are deleted, so that the blocks of one section,
language or layout and rotating ones go too. Subtrees of over 200 characters and those inside an article must recur on
``least_long``: there pages quote one another. Of a large host's bodies it must be a thousandth, so that what a few of very many
pages share by chance stays. A plain paragraph or heading is never template by itself, since texts quote one another; one with
a class or id can be. Nor is a long subtree with most of a page's text, which is a copied story. What no page shares with
another, such as an advert of its own text, goes by what it is: elements for navigation, headers, footers, sidebars, forms and
scripts, and elements whose role, class or id says menu, advert, notice, comments and the like. Templates are deleted before an
article or main element is looked for and inside it; if one is left, the text is taken from there, otherwise from the rest of the body.

With ``rules=False`` template removal works alone: nothing is known by tag, role, class or id, and no article is chosen.

Character references are decoded, white space inside a block becomes one space, blocks are joined by two line ends; nothing is
cut to a length. Null html is empty and gives an empty text; pages whose url has no host are extracted without template removal.
Repeated pages get equal texts; of equally good main elements all count, in page order. Very long pages are parsed whole, alone in
their batch. An empty table gives no rows. Extra columns stay, whatever their names; one of the result's name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, free_name, others, slices, written
from .html_tree import BLOCK, Node, hash_subtrees, parse

#: Elements, roles and class or id words of what is not main text.
DROPPED = frozenset("head script style noscript template nav footer aside form iframe object embed svg math canvas audio video map button select textarea input datalist dialog menu search title noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist status".split())
WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertising advertorial banner banners breadcrumb breadcrumbs captcha comment comments "
    "commentlist consent cookie cookies copyright cta disclaimer disqus donate feedback footer gdpr login masthead menu menus modal nav navbar navigation "
    "navigationbar newsletter notice notices notification overlay pager pagination paywall popup popover promo promos promotion related recommended "
    "recommendations replies reply respond search share sharing shares sidebar sidebars signup skip social sponsor sponsored sponsors subscribe "
    "subscription tags taglist teaser toolbar topbar tracking widget widgets".split()
)
#: Only outside an article.
OUTER_WORDS = frozenset("header headers top bottom".split())
MAIN_WORDS = frozenset("article articlebody content maincontent main post postcontent entry entrycontent story".split())
#: Characters of text from which on a subtree is long.
LONG = 200
#: Elements without text, always left out.
TECHNICAL = frozenset("head title script style noscript template iframe object embed svg math canvas audio video map textarea noembed noframes".split())
#: Elements whose subtrees can be template; those that can be only with a class or id; those that can be inside an article.
STRUCTURE = frozenset("div section ul ol dl table header footer nav aside form center menu details fieldset address".split())
TEXTUAL = frozenset("p blockquote h1 h2 h3 h4 h5 h6 span a".split())
INNER_STRUCTURE = frozenset("div section aside nav header footer form menu fieldset details".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _words(node: Node) -> set[str]:
    names = node.get("class") + " " + node.get("id")
    return {w.lower() for w in _WORD.findall(names)} if names != " " else set()


def _is_main(node: Node) -> bool:
    return node.tag in ("article", "main") or node.get("role").lower() in ("main", "article") or node.get("itemprop").lower() == "articlebody"


def _hidden(node: Node) -> bool:
    return node.raw != "" and (node.has("hidden") or node.get("aria-hidden").lower() == "true" or "display:none" in node.get("style").replace(" ", "").lower())


def _chrome(node: Node, in_main: bool, holds_main: bool) -> bool:
    """Whether an element is known not to be main text, by its tag, role, class or id."""
    tag = node.tag
    if tag in DROPPED:
        return not (tag in ("form", "object") and holds_main)
    if tag == "header" and not in_main:
        return not holds_main
    if not node.raw or tag in ("html", "body"):
        return False
    if _hidden(node):
        return True
    if holds_main:
        return False
    if node.get("role").lower() in ROLES:
        return True
    words = _words(node)
    return bool(words & WORDS) or (not in_main and bool(words & OUTER_WORDS))


def _marks(root: Node) -> dict[int, tuple[bool, bool]]:
    """For each element: whether it stands in a main element, and whether it holds one."""
    order = list(root.nodes())
    holds: set[int] = set()
    for node in reversed(order):
        if (_is_main(node) or id(node) in holds) and node.parent is not None and node.tag not in ("nav", "aside", "footer", "template", "noscript"):
            if not (_words(node) & WORDS and node.raw):  # a comment is no article of the page
                holds.add(id(node.parent))
    out: dict[int, tuple[bool, bool]] = {}
    for node in order:
        up = node.parent
        out[id(node)] = (up is not None and (out[id(up)][0] or _is_main(up)), id(node) in holds)
    return out


def _can_be_template(node: Node, in_main: bool, holds_main: bool, whole: int, rules: bool) -> bool:
    """``whole`` is the size of the page's text."""
    if not node.size or (node.size > LONG and 2 * node.size > whole):
        return False
    if rules and (holds_main or _is_main(node)):
        return False
    if rules and in_main:
        return node.tag in INNER_STRUCTURE
    return node.tag in STRUCTURE or (node.tag in TEXTUAL and bool(node.get("class") or node.get("id")))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _key(node: Node, in_main: bool, rules: bool) -> int:
    """The hash under which a subtree is counted (signed); it is odd where ``least_long`` holds."""
    long = node.size > LONG or (rules and in_main)
    return _signed(node.hash & ~1 | long)


def candidates(root: Node, rules: bool = True) -> list[int]:
    """Distinct keys of the subtrees that can be a site's template."""
    marks = _marks(root)
    return sorted({_key(node, marks[id(node)][0], rules) for node in root.nodes() if _can_be_template(node, *marks[id(node)], root.size, rules)})


def _blocks(node: Node, skip, out: list[list[str]]) -> None:
    """Appends the text of an element to the last block, with new blocks where block elements begin and end."""
    stack: list = [(node, 0)]
    while stack:
        node, i = stack.pop()
        if i == 0:
            if node.tag in BLOCK:  # a deleted block still parts the text around it
                out.append([])
            if skip(node):
                continue
        items = node.items
        while i < len(items):
            x = items[i]
            i += 1
            if isinstance(x, Node):
                if x.tag in ("br", "td", "th", "img", "wbr", "input"):
                    out[-1].append("" if x.tag == "wbr" else " ")
                stack.append((node, i))
                stack.append((x, 0))
                break
            out[-1].append(unescape(x))
        else:
            if node.tag in BLOCK:
                out.append([])
            elif node.tag in ("td", "th"):
                out[-1].append(" ")


def main_text(html: str, template: set[int] | None = None, rules: bool = True) -> str:
    """The main text of a page, given the hashes of the template of its site."""
    root = parse(html)
    marks = _marks(root)
    if template:
        hash_subtrees(root)
    deleted: dict[int, bool] = {}

    def skip(node: Node) -> bool:
        if (known := deleted.get(id(node))) is None:
            in_main, holds = marks[id(node)]
            known = _chrome(node, in_main, holds) if rules else node.tag in TECHNICAL
            if not known and template and _can_be_template(node, in_main, holds, root.size, rules):
                known = _key(node, in_main, rules) in template
            deleted[id(node)] = known
        return known

    mains: list[Node] = []
    stack = [root] if rules else []
    while stack:  # outermost main elements that are not deleted
        node = stack.pop()
        if node is not root and skip(node):
            continue
        if _is_main(node):
            mains.append(node)
        else:
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
    for i, node in enumerate(mains):
        inner = [x for x in node.nodes() if x is not node and x.tag == "article" and not _skipped(x, node, skip)]
        if node.tag != "article" and len(inner) == 1:
            mains[i] = inner[0]
    found = mains or [root]
    if rules and not mains:
        named = [x for x in root.nodes() if x.raw and x.tag in ("div", "section", "td") and _words(x) & MAIN_WORDS and not _skipped(x, root, skip)]
        if len(named) == 1:
            found = named
    blocks: list[list[str]] = [[]]
    for node in found:
        _blocks(node, skip if node is root else lambda x, top=node: x is not top and skip(x), blocks)
        blocks.append([])
    texts = (" ".join("".join(b).split()) for b in blocks)
    return "\n\n".join(t for t in texts if t)


def _skipped(node: Node, top: Node, skip) -> bool:
    while node is not None and node is not top:
        if skip(node):
            return True
        node = node.parent
    return False


def _hashes(rules: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html", 1 << 20):
            bodies, hashes, names = [], [], [c for c in batch.schema.names if c != "html"]
            for html in batch.column("html").to_pylist():
                root = parse(html)
                hash_subtrees(root)
                bodies.append(_signed(root.hash))
                hashes.append(candidates(root, rules))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bodies, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=[*names, "body", "hashes"])

    return run


def _texts(names: list[str], body: str, template: str, into: str, sites, rules: bool):
    """``template`` has the page's host, or where ``sites`` is None the hashes of its host's template that stand on the page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_host = sites.value if sites is not None else None
        for batch in slices(batches, body, 1 << 20):
            known = batch.column(template).to_pylist()
            known = [of_host.get(h) if of_host is not None else h and set(h) for h in known]
            texts = [main_text(h, t, rules) for h, t in zip(batch.column(body).to_pylist(), known, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, into])

    return run


def host_of(url):
    """The host of an absolute url in small letters; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?i)^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]+)", 1))


def templates(hashed: DataFrame, least_pages: int, least_long: int, least_share: float) -> DataFrame:
    """(host, hash) of the subtrees on at least that many different bodies of a host, and that share of them."""
    bodies = hashed.where("host <> ''").select("host", "body", "hashes")
    of_host = bodies.select("host", "body").distinct().groupBy("host").agg(F.count("*").alias("bodies"))
    # copies of a body add nothing: the first aggregation leaves one row for each
    seen = bodies.select("host", "body", F.explode("hashes").alias("hash")).distinct().groupBy("host", "hash").agg(F.count("*").alias("n"))
    seen = seen.where(F.col("n") >= F.when(F.expr("hash & 1 = 1"), least_long).otherwise(least_pages))
    return seen.join(of_host, "host").where(F.col("n") >= least_share * F.col("bodies")).select("host", "hash")


def extract_main_text(
    pages: DataFrame, *, html: str = "html", url: str = "url", into: str = "main_text", least_pages: int = 2, least_long: int = 5, least_share: float = 0.001, rules: bool = True, most_broadcast: int = 200_000
) -> DataFrame:
    """pages with their main text; a column of that name is replaced.

    A subtree is template from ``least_pages`` different bodies of its host on (``least_long`` where it is long or in an article), and
    from ``least_share`` of them on. Up to ``most_broadcast``
    template hashes of all hosts are sent to the tasks, more are joined to the pages that have them, with the same result.
    """
    source, host = F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")), host_of(F.col(f"`{url}`"))
    page = F.xxhash64(source)
    hashed = pages.select(host.alias("host"), page.alias("page"), source.alias("html")).mapInArrow(_hashes(rules), "host string, page long, body long, hashes array<long>")
    hashed = written(hashed, "subtrees")
    site = written(templates(hashed, least_pages, least_long, least_share), "templates")
    names = others(pages, into)
    body, template = free_name(pages, "__html"), free_name(pages, "__template")
    rows = pages.select(*(F.col(f"`{c}`") for c in names), source.alias(body), host.alias(template))
    sites = None
    if site.count() <= most_broadcast:  # 8 bytes each, and the host names
        of_host: dict[str, set[int]] = {}
        for r in site.toLocalIterator():
            of_host.setdefault(r.host, set()).add(r.hash)
        sites = pages.sparkSession.sparkContext.broadcast(of_host)
        drop_written(hashed, site)
    else:
        # a host can have many templates, a page has few of them: it gets those that stand on it. A hash is dealt over 32 keys
        dealt = site.withColumn("salt", F.explode(F.array(*map(F.lit, range(32)))))
        found = hashed.select("host", "page", F.explode("hashes").alias("hash")).distinct().withColumn("salt", F.pmod("page", F.lit(32)).cast("int"))
        lists = found.join(dealt, ["host", "hash", "salt"]).groupBy("host", "page").agg(F.collect_list("hash").alias("__hashes"))
        near = (F.col(template) == F.col("__site.host")) & (F.xxhash64(body) == F.col("__site.page"))
        rows = rows.join(lists.alias("__site"), near, "left").select(*(F.col(f"`{c}`") for c in names), body, F.col("__site.__hashes").alias(template))
    return rows.mapInArrow(_texts(names, body, template, into, sites, rules), T.StructType([*(pages.schema[c] for c in names), T.StructField(into, T.StringType())]))


def op5(spark, sf_dir: str) -> DataFrame:
    pages = extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return pages.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))
