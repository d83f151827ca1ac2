"""Main text of web pages with a site style tree (operator 5).

The different pages of a host are merged into one style tree.  Its nodes are paths of
tags with their classes and their position among equal siblings, at every depth.  A node
has a *presentation* on each page, the row of its child elements, and a *content*, the
text that stands directly in it.  P and C are the entropies (in nats) of both over the m
pages that have the node.  Importance is composed along the path from the root, from 0 to 1:

    C' = (1 - exp(-C)) / (1 - 1 / m)
    importance = C' * (DAMPED + (1 - DAMPED) * max P around / max P of the host)

where *around* is the element itself and all that it stands in.  So what repeats is of no
importance anywhere, and what changes counts in full only where the layout changes from
page to page about as much as anywhere on the host, as that of articles does, while
menus, adverts and footers change their words more than their layout.

A node that few pages of a host have says little, so both factors are drawn to those of
the same path in a tree of all hosts (its C' is the hosts' mean) as if that were
``PRIOR`` and, for content, ``CONTENT_PRIOR`` pages more, and these in turn to a prior: 1
for content, and for the layout what HTML alone says, 0 for what elements or ARIA roles
name as no main text (navigation, page headers and footers, asides, forms, nested
articles, which are comments) and, on a page with an ``article`` or ``main`` element, for
what stands outside of it; 1 for the rest.
A host's first page is judged by that alone, the tree decides more with each page, and
there is no switch.  Branches below ``LEAST`` are removed from each page, inside articles
too; a page with nothing above it keeps what comes within ``LEAST`` of its best.

Reader comments vary as articles do.  They are told by a second presentation, that of
sibling elements of one name, all positions taken together (a *row*): a row is removed
from every page of its host if at least ``ROW_PAGES`` pages have it, it does repeat there, most
of its elements have the same children, what stands in front of it is more main text than
it holds, and next to none stands behind it.  Paragraphs, headings and parts of tables are
no rows; a host's first pages have none.

The tree is never built in one place: pages emit their nodes, copies of a page once, and
counts are combined before the shuffle.  A host of up to ``LISTED`` nodes of low importance
sends them to its pages as one list; pages of other hosts look up their own nodes, so no
row grows with a host.  The joins back to the pages may be split by AQE, so a host with a
third of all pages is no single task's work.

Defined results: a null or empty page has the empty text; a null or odd url counts as
a host of its own name; an unfinished tag at the end is dropped; scripts, styles, heads,
hidden elements and form controls are never text; importance ties stay; very long pages
are walked whole, in one pass; an empty table gives an empty result; extra columns are
ignored; repeated rows repeat.  Hosts, paths and contents are compared by 64-bit hashes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memlake.llm.storage import bounded_batches, materialize, workspace

PRIOR, CONTENT_PRIOR, LEAST, DAMPED = 8, 1, 0.5, 0.1
#: Pages that must have a row, share of its elements that have equal children, and main text behind it against that in front.
ROW_PAGES, ROW_SAME, ROW_BEHIND = 3, 0.6, 0.1
#: The tree of all hosts, in place of a host's hash.
ALL = 0
#: Kinds of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|math|object|canvas|select|button"
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr img".split())
NAMED = frozenset("nav footer aside form dialog menu fieldset".split())
NEVER = frozenset("head audio video map frameset noframes".split())
MAIN = frozenset(("article", "main"))
ROWS = frozenset(("div", "li", "section", "dd"))
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSES_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar form comment".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<(?P<raw>" + RAW + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_OPEN_END = re.compile(r"<[a-zA-Z/][^>]*\Z")
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)


_hash = xxhash.xxh3_64_intdigest
#: Nodes of low importance that a host may send to each of its pages as one list.
LISTED = 1024


class _Node:
    __slots__ = ("tag", "path", "above", "hidden", "named", "main", "kids", "equal", "texts", "rows")

    def __init__(self, tag: str, path: int, above: int, hidden: bool, named: bool, main: bool, rows: tuple[int, ...] = ()):
        self.tag, self.path, self.above, self.hidden, self.named, self.main = tag, path, above, hidden, named, main
        self.kids: list[str] = []
        self.equal: dict[str, int] = {}
        self.texts: list[str] = []
        #: Rows of siblings that the element stands in, its own last.
        self.rows = rows


def _read(attrs: str) -> tuple[str, bool, bool]:
    """Classes for the style of an element, whether it is hidden, and whether its role is no main text."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return "", False, False
    style, hidden, named = "", False, False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "class":
            style += "." + value
        elif name == "role":
            named |= value in ROLES
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name == "style":
            hidden |= "display:none" in value.replace(" ", "")
    return style, hidden, named


def walk(page: str) -> tuple[list[_Node], list[tuple[_Node, str]], bool]:
    """Elements of a page that can hold text, its blocks of text with their elements, whether it has a main element."""
    stack = [_Node("", 0, 0, False, False, False)]
    nodes, blocks, block = [stack[0]], [], []
    has_main = False

    def flush() -> None:
        if block:
            text = " ".join("".join(block).split())
            block.clear()
            node = stack[-1]
            if text and not node.hidden:
                node.texts.append(text)
                blocks.append((node, text))

    def text_of(raw: str) -> None:
        if raw:
            block.append(html.unescape(raw) if "&" in raw else raw)

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            text_of(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            block.append(" ")
            continue
        if tag in INLINE or (tag in VOID and tag != "hr"):
            continue
        if m["end"]:
            if any(n.tag == tag for n in stack[1:]):
                flush()
                while stack.pop().tag != tag:
                    pass
            continue
        flush()
        if tag in CLOSES_P and stack[-1].tag == "p":
            stack.pop()
        if stack[-1].tag in CLOSES_SAME.get(tag, ()):
            stack.pop()
        if tag == "hr":
            continue
        top = stack[-1]
        style, hidden, named = _read(m["attrs"])
        name = tag + style
        top.kids.append(name)
        # Equal siblings are nodes of their own, so that each is judged and removed by its own content.
        nth = top.equal[name] = top.equal.get(name, 0) + 1
        main = tag in MAIN
        named |= tag in NAMED or (tag == "header" and not top.main) or (tag == "article" and top.main and any(n.tag == "article" for n in stack))
        if tag in ("html", "body"):
            hidden = named = False
        node = _Node(tag, _hash(f"{top.path}/{name}/{nth}"), top.path, top.hidden or hidden or tag in NEVER, top.named or named, top.main or main, (*top.rows, _hash(f"{top.path}|{name}")) if tag in ROWS else top.rows)
        has_main |= main and not node.hidden and not node.named
        if m["attrs"].endswith("/") and tag not in ("p", "div"):
            continue
        stack.append(node)
        nodes.append(node)
    text_of(_OPEN_END.sub("", page[at:]))
    flush()
    return [n for n in nodes if not n.hidden], blocks, has_main


def prior(node: _Node, has_main: bool) -> float:
    """Importance of an element by HTML alone."""
    return float(not node.named and (node.main or not has_main))


def chosen(page: str, low: dict[int, float] | None) -> str:
    """Main text of a page: blocks of importance ``LEAST`` or more, or its best ones; without ``low`` by HTML alone."""
    _, blocks, has_main = walk(page)
    worth = [prior(n, has_main) if low is None else min(low.get(x, 1.0) for x in (n.path, *n.rows)) for n, _ in blocks]
    best = max(worth, default=1.0)
    bar = LEAST if best >= LEAST else LEAST * best
    return "\n".join(t for (_, t), w in zip(blocks, worth, strict=True) if w >= bar)


def page_rows(nodes: list[_Node], blocks: list[tuple[_Node, str]], has_main: bool) -> list[tuple]:
    """Rows of a page: (row, elements, their most usual children, how many have those, own characters, main characters in front and behind)."""
    found: dict[int, Counter] = {}
    for n in nodes:
        if n.tag in ROWS:
            found.setdefault(n.rows[-1], Counter())[_hash(" ".join(n.kids)) if n.kids else 0] += 1
    upto, own, first, last = [0], Counter(), {}, {}
    for at, (n, text) in enumerate(blocks):
        upto.append(upto[-1] + len(text) * int(prior(n, has_main)))
        for row in n.rows:
            own[row] += len(text)
            first.setdefault(row, at)
            last[row] = at
    rows = []
    for row, layouts in found.items():
        if row in first:
            layout, same = min(layouts.items(), key=lambda x: (-x[1], x[0]))
            rows.append((row, layouts.total(), layout, same, own[row], upto[first[row]], upto[-1] - upto[last[row] + 1]))
    return rows


def host_of(url: Column) -> Column:
    """Lower-case host name of a url column, the whole value where there is none."""
    found = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.coalesce(F.when(found != "", found).otherwise(url), F.lit(""))


def page_hash(html: Column) -> Column:
    """Hash of a page, by which copies are told."""
    return F.xxhash64(F.coalesce(html, F.lit("")))


def style_rows(pages: DataFrame) -> DataFrame:
    """Rows (site, page, nodes, rows) of all pages: hashes of host and page, the page's elements with presentation and content, and its rows."""

    def signed(values: list[int | None]) -> pa.Array:
        return pa.array([None if v is None else v - (v >> 63 << 64) for v in values], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends, groups, group_ends = [], [0], [], [0]
            pages = batch.column("html").to_pylist()
            for page in pages:
                nodes, blocks, has_main = walk(page)
                groups += page_rows(nodes, blocks, has_main)
                group_ends.append(len(groups))
                found += [(n.path, n.above, _hash(" ".join(n.kids)) if n.kids else None, _hash("\n".join(n.texts)) if n.texts else None, prior(n, has_main)) for n in nodes]
                ends.append(len(found))
            path, above, layout, content, by_html = zip(*found, strict=True) if found else ((),) * 5
            parts = [signed(path), signed(above), signed(layout), signed(content), pa.array(by_html, pa.float32())]
            nodes = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["path", "above", "layout", "content", "by_html"]))
            row, n, kids, *numbers = zip(*groups, strict=True) if groups else ((),) * 7
            parts = [signed(row), pa.array(n, pa.int64()), signed(kids), *(pa.array(x, pa.int64()) for x in numbers)]
            rows = pa.ListArray.from_arrays(pa.array(group_ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["row", "n", "layout", "same", "own", "front", "behind"]))
            yield pa.RecordBatch.from_arrays([batch.column("site"), batch.column("page"), nodes, rows], names=["site", "page", "nodes", "rows"])

    rows = bounded_batches(pages.select("site", page_hash(F.col("html")).alias("page"), F.coalesce("html", F.lit("")).alias("html")))
    return rows.mapInArrow(run, "site long, page long, nodes array<struct<path long, above long, layout long, content long, by_html float>>, rows array<struct<row long, n long, layout long, same long, own long, front long, behind long>>")


def _entropy(nodes: DataFrame, kind: str) -> DataFrame:
    """Rows (site, path, m, nats): pages that have the node, and the entropy of one of its hashes over them."""
    counts = nodes.where(F.col(kind).isNotNull()).groupBy("site", "path", kind).agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("site", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("s"))
    return sums.select("site", "path", "m", F.greatest(F.lit(0.0), F.ln("m") - F.col("s") / F.col("m")).alias("nats"))


def repeated_rows(rows: DataFrame) -> DataFrame:
    """Rows (site, path, worth 0) of what is a row of comments on its host (rows: site and a page's row)."""
    by_layout = rows.groupBy("site", "row", "layout").agg(F.count(F.lit(1)).alias("pages"), *(F.sum(c).alias(c) for c in ("n", "same", "own", "front", "behind")))
    # Pages whose most usual children are the host's most usual ones bring in all of theirs that have those.
    whole = by_layout.groupBy("site", "row").agg(F.max("same").alias("same"), *(F.sum(c).alias(c) for c in ("pages", "n", "own", "front", "behind")))
    told = (F.col("pages") >= ROW_PAGES) & (F.col("n") >= F.col("pages") + 2) & (F.col("same") >= ROW_SAME * F.col("n")) & (F.col("front") > F.col("own")) & (F.col("behind") <= ROW_BEHIND * F.col("front"))
    return whole.where(told).select("site", F.col("row").alias("path"), F.lit(0.0).alias("worth"))


def importance(pages: DataFrame) -> DataFrame:
    """Rows (site, path, worth): importance of every node with text of every host, and 0 for rows of comments (rows: ``site``, a hash, and ``html``)."""
    with workspace(pages.sparkSession, "style-tree") as keep:
        once = keep(style_rows(pages).dropDuplicates(["site", "page"]), "pages")  # copies of a page say nothing about a site
        rows_of = once.select("site", F.explode("rows").alias("r")).select("site", "r.*")
        nodes = keep(once.select("site", F.explode("nodes").alias("n")).select("site", "n.*"), "nodes")
        # All hosts together are one more tree, of presentations only.
        both = nodes.unionByName(nodes.withColumn("site", F.lit(ALL)))
        known = both.groupBy("site", "path").agg(F.max("above").alias("above"))
        layouts = keep(_entropy(both, "layout").select("site", "path", "nats"), "layouts")
        most = layouts.groupBy("site").agg(F.max("nats").alias("most"))
        # The greatest entropy around each node: steps of 1, 2, 4, ... elements up the tree.
        tree = keep(known.join(layouts, ["site", "path"], "left").select("site", "path", F.coalesce("nats", F.lit(0.0)).alias("around"), F.when(F.col("path") != 0, F.col("above")).alias("above")), "tree")
        while not tree.where("above is not null").isEmpty():
            up = tree.select("site", F.col("path").alias("above"), F.col("around").alias("further"), F.col("above").alias("next"))
            tree = keep(tree.join(up, ["site", "above"], "left").select("site", "path", F.greatest("around", "further").alias("around"), F.col("next").alias("above")), "tree")
        lively = F.when(F.col("most") > 0, F.col("around") / F.col("most")).otherwise(0.0)
        tree = tree.join(most, "site", "left").select("site", "path", (DAMPED + (1 - DAMPED) * lively).alias("lively"))
        varied = F.when(F.col("m") > 1, (1 - F.exp(-F.col("nats"))) / (1 - 1 / F.col("m"))).otherwise(0.0)
        by_html = nodes.groupBy("site", "path").agg(F.max("by_html").alias("by_html"))
        text = keep(_entropy(nodes, "content").select("site", "path", (F.col("m") - 1).alias("more"), varied.alias("varied")).join(tree, ["site", "path"]).join(by_html, ["site", "path"]), "text")
        pool = text.groupBy("path").agg(F.sum("more").alias("all"), F.sum(F.col("more") * F.col("varied")).alias("sum"))
        pool = pool.join(tree.where(F.col("site") == ALL).select("path", F.col("lively").alias("usual")), "path")
        mixed = lambda n, value, weight, other: (n * value + weight * other) / (n + weight)
        more, every = F.col("more"), F.col("all")
        content = mixed(more, F.col("varied"), CONTENT_PRIOR, (F.col("sum") + CONTENT_PRIOR) / (every + CONTENT_PRIOR))
        layout = mixed(more, F.col("lively"), PRIOR, mixed(every, F.col("usual"), PRIOR, F.col("by_html")))
        rows = text.join(pool, "path").select("site", "path", (content * layout).alias("worth"))
        return materialize(rows.unionByName(repeated_rows(rows_of)), "style-importance")


def _own_low(pages: DataFrame, low: DataFrame) -> DataFrame:
    """Rows (site, page, paths, worths): the nodes and rows of low importance that a page has itself."""
    own = style_rows(pages).dropDuplicates(["site", "page"])
    paths = F.array_union(F.transform("nodes", lambda n: n["path"]), F.transform("rows", lambda r: r["row"]))
    found = own.select("site", "page", F.explode(paths).alias("path")).join(low, ["site", "path"])
    return found.groupBy("site", "page").agg(F.collect_list("path").alias("paths"), F.collect_list("worth").alias("worths"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", listed: int = LISTED) -> DataFrame:
    """Rows (page_id, url, text): the main text of every page.

    Hosts of more than ``listed`` nodes of low importance are joined by the nodes of their pages; the result is the same.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html")).withColumn("site", F.xxhash64(host_of(F.col("url"))))
    low = importance(rows).where(F.col("worth") < LEAST)
    few = low.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
    large = materialize(few.where(F.col("n") > listed).select("site"), "style-large")
    listing = low.join(large, "site", "left_anti").groupBy("site").agg(F.collect_list("path").alias("paths"), F.collect_list("worth").alias("worths"))
    listing = materialize(listing, "style-low").withColumnRenamed("site", "of")
    columns = ["page_id", "url", "html", "paths", "worths"]
    if large.isEmpty():
        joined = rows.join(listing, F.col("site") == F.col("of"), "left").select(*columns)
    else:
        rows = rows.withColumn("page", page_hash(F.col("html")))
        far = rows.join(large, "site", "left_semi")
        own = materialize(_own_low(far.select("site", "html"), low), "style-own").select(F.col("site").alias("of"), F.col("page").alias("same"), "paths", "worths")
        near = rows.join(large, "site", "left_anti").join(listing, F.col("site") == F.col("of"), "left").select(*columns)
        joined = near.unionByName(far.join(own, (F.col("site") == F.col("of")) & (F.col("page") == F.col("same")), "left").select(*columns))
    joined = bounded_batches(joined)
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths, worths in zip(batch.column("html").to_pylist(), batch.column("paths"), batch.column("worths"), strict=True):
                low = dict(zip(paths.values.to_numpy().view(np.uint64).tolist(), worths.values.to_numpy().tolist(), strict=True)) if paths.is_valid else {}
                texts.append(chosen(page or "", low))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)
