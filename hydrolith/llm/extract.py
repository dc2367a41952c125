"""Main text of web pages by site style trees.

The pages of one host are merged into one tree. An element node stands for a run
of like siblings (same tag, same words in classes and id) at one place of a
layout; a style node is a layout, the order of an element's runs. So an element
node is named by its parent's style node and its place in it, and a style node by
its element node and its runs. Text stands in leaves of its own.

Importance. Presentation: the entropy of an element's styles over the pages that
have it, to the base of their number. Content: 1 less the mean entropy of the
texts of a leaf over the pages. Composite: with l styles, a share of 1 - GAMMA**l
is the element's presentation and the rest the mean over its styles, by their
pages, of their children's composites. What is on fewer than ``PAGES`` pages has
importance 1: there is no evidence against it. Composites are linear in what the
nodes below give, so they are one sum over (node, ancestor) and no walk up level
by level.

Elements say what they are, too (``markup.Prior``): importances are a mean of the
tree's and the prior's. Menus, footers, forms, comments and the like are so sure of
it that the tree is not asked; a word that an article may use for a part of its own
(``markup.DOUBTED``) yields to a tree that has seen it with other text each time, and
stands where the tree has seen too few pages. A branch is removed from each page of the host if its
composite is under ``LEAST`` and no content in it reaches ``SURE``. An article, or
what names itself so, is the page's only if it holds most of what is left.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.batches import give_back
from hydrolith.llm.common import cut, small_batches, table
from hydrolith.llm.markup import ARTICLE, CUE, DOUBTED, MAIN, NEUTRAL, OWN, Block, Element, Prior, blocks, node_id

GAMMA = 0.9
LEAST, SURE = 0.6, 0.8
#: Pages of a host that a node must be on before the tree judges it.
PAGES = 4
#: Share of a block's characters inside links that makes it a menu.
LINKED = 0.6
#: Share of a page's text that the containers of its article hold.
MOST = 0.5
#: Counts that a task holds before it hands them on.
HELD = 200_000
#: Nodes of all hosts together up to which the weak ones are broadcast (about 20 bytes each).
BROADCAST_NODES = 200_000
#: Parts that a host's pages are dealt to where its nodes are not broadcast.
SALT = 32


def host(url: Column) -> Column:
    """Lower-cased host without port; empty for a null or odd address."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def named(root: Element) -> Iterator[tuple[Element | Block, int, int, tuple[int, ...]]]:
    """Each element and block under ``root`` with its node, its style node (0 for
    a block) and the style nodes above it from the top."""
    todo: list[tuple[Element | Block, int, tuple[int, ...]]] = [(root, node_id(""), ())]
    while todo:
        x, node, above = todo.pop()
        if isinstance(x, Block):
            yield x, node, 0, above
            continue
        runs: list[str] = []
        place = []
        for item in x.items:
            key = "#" if isinstance(item, Block) else item.key
            if not runs or runs[-1] != key:
                runs.append(key)
            place.append(len(runs))
        style = node_id(f"{node} {' '.join(runs)}")
        yield x, node, style, above
        todo += [(item, node_id(f"{style} {at}"), (*above, style)) for item, at in zip(x.items, place, strict=True)]


COUNTS = pa.schema([("host", pa.string()), ("node", pa.int64()), ("kind", pa.int8()), ("feature", pa.int64()), ("above", pa.list_(pa.int64())), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, node, kind (0 a page, 1 a style, 2 a text, 3 a page where the element's
    name is in doubt), feature, the styles above (of kind 0), pages."""
    held: Counter = Counter()

    def flush() -> pa.RecordBatch:
        rows = [(*k, n) for k, n in held.items()]
        held.clear()
        cols = zip(*rows, strict=True) if rows else [()] * len(COUNTS)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, COUNTS, strict=True)], schema=COUNTS)

    for b in batches:
        for site, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            seen = set()
            for x, node, style, above in named(blocks(page or "")[0]):
                seen.add((site, node, 0, 0, above))
                seen.add((site, node, 1, style, None) if style else (site, node, 2, node_id(x.text), None))
                if style and x.prior is DOUBTED:
                    seen.add((site, node, 3, 0, None))
            held.update(seen)
        give_back()
        if len(held) > HELD:
            yield flush()
    if held:
        yield flush()


def site_tree(pages: DataFrame) -> DataFrame:
    """host, node, pages, own (its presentation, or a leaf's content), doubted (its
    name is), composite and top (the most content in the branch) of each node that is
    on ``PAGES`` pages of its host. ``pages`` has host and html."""
    small_batches(pages.sparkSession, 500)
    rows = pages.mapInArrow(_counted, "host string, node long, kind byte, feature long, above array<long>, n long")
    counted = cut(rows.groupBy("host", "node", "kind", "feature").agg(F.sum("n").alias("n"), F.first("above", ignorenulls=True).alias("above")))
    n = F.col("n").cast("double")
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0.0))
    t = counted.groupBy("host", "node").agg(
        of(0, n).alias("pages"), F.first("above", ignorenulls=True).alias("above"),
        of(1, F.lit(1.0)).alias("styles"), of(1, n).alias("s"), of(1, n * F.log(n)).alias("sl"), of(1, F.when(n < PAGES, n).otherwise(0.0)).alias("rare"),
        (of(3, n) > 0).alias("doubted"), of(2, F.lit(1.0)).alias("texts"), of(2, F.log(n)).alias("tl"),
    ).filter(F.col("pages") >= PAGES)
    m = F.log("pages")
    leaf = F.col("texts") > 0
    own = F.when(leaf, 1.0 - F.col("tl") / F.col("texts") / m).otherwise((F.log("s") - F.col("sl") / F.col("s")) / m)
    passed = F.pow(F.lit(GAMMA), F.col("styles"))  # what the children have a share of
    t = cut(t.withColumns({"own": own, "passed": passed}).withColumns({
        "gives": F.when(leaf, F.col("own")).otherwise((1.0 - F.col("passed")) * F.col("own") + F.col("passed") * F.col("rare") / F.col("s")),
        "most": F.when(leaf, F.col("own")).when(F.col("rare") > 0, 1.0).otherwise(0.0),
    }))
    # How much of a child's composite an element takes through a style.
    children = t.select("host", F.try_element_at("above", F.lit(-1)).alias("feature")).filter("feature IS NOT NULL").groupBy("host", "feature").agg(F.count("*").alias("k"))
    styles = counted.filter((F.col("kind") == 1) & (F.col("n") >= PAGES)).select("host", "node", "feature", "n").join(t.select("host", "node", "passed", "s"), ["host", "node"]).join(children, ["host", "feature"])
    takes = styles.select("host", F.col("feature").alias("style"), F.col("node").alias("over"), (F.col("passed") * F.col("n") / F.col("s") / F.col("k")).alias("w"))
    steps = t.select("host", "node", "gives", "most", F.posexplode("above").alias("i", "style")).join(takes, ["host", "style"])
    paths = steps.groupBy("host", "node").agg(F.first("gives").alias("gives"), F.first("most").alias("most"), F.reverse(F.sort_array(F.collect_list(F.struct("i", "w", "over")))).alias("path"))
    # From the parent up, with the product of what each step takes.
    step = lambda acc, x: F.struct((acc["w"] * x["w"]).alias("w"), F.array_append(acc["to"], F.struct(x["over"].alias("over"), (acc["w"] * x["w"]).alias("w"))).alias("to"))
    start = F.struct(F.lit(1.0).alias("w"), F.array().cast("array<struct<over:bigint,w:double>>").alias("to"))
    up = paths.select("host", "gives", "most", F.explode(F.aggregate("path", start, step, lambda acc: acc["to"])).alias("x"))
    each = up.select("host", F.col("x.over").alias("node"), (F.col("gives") * F.col("x.w")).alias("gives"), "most").union(t.select("host", "node", "gives", "most"))
    whole = each.groupBy("host", "node").agg(F.sum("gives").alias("composite"), F.max("most").alias("top"))
    return t.select("host", "node", F.col("pages").cast("long").alias("pages"), "own", "doubted").join(whole, ["host", "node"])


def weak(composite: float, top: float, prior: Prior) -> bool:
    """Whether a branch goes, by the tree and by what it says of itself."""
    value, share = prior
    return (1 - share) * composite + share * value < LEAST and (1 - share) * top + share * value < SURE


def main_blocks(page: str, low: dict[int, tuple[float, float]]) -> tuple[list[str], int, int]:
    """The texts of the blocks that stay, in order; how many of the branches'
    blocks went that the tree alone removes, and how many only with the priors.

    ``low`` has composite and top of the host's nodes of little importance, and of
    those whose name is in doubt. A
    kind of container is taken for the page's article only if it holds ``MOST``
    of the text that is left and is not in links: a byline or a teaser in one
    does not stand for the page. A page that the tree would empty (a copy of its
    neighbours) keeps what the priors leave."""
    root, found = blocks(page)
    gone: dict[int, tuple[bool, bool, bool]] = {}  # by element or block: by both, by its prior, by the tree
    for x, node, _, _ in named(root):
        block = isinstance(x, Block)
        over = gone[id(x.parent)] if x.parent is not None else (False, False, False)
        prior = (OWN if x.parent.within else (1.0, 0.0)) if block else x.prior
        own = weak(1.0, 1.0, prior) or prior is DOUBTED and node not in low
        gone[id(x)] = over[0] or own or node in low and weak(*low[node], prior), over[1] or own, over[2] or node in low and weak(*low[node], NEUTRAL)
    plain = [b for b in found if not gone[id(b)][1]]
    kept = [b for b in found if not gone[id(b)][0]]
    by_tree = sum(gone[id(b)][0] and gone[id(b)][2] for b in found)
    by_prior = len(found) - len(kept) - by_tree
    said = [b for b in kept if b.linked < LINKED]
    least = MOST * sum(len(b.text) for b in said)
    for part in (ARTICLE, MAIN, CUE):
        inside = [b for b in said if b.parent.within & part]
        if inside and sum(len(b.text) for b in inside) >= least:
            return [b.text for b in kept if b.parent.within & part], by_tree, by_prior
    if said:
        return [b.text for b in said], by_tree, by_prior
    return [b.text for b in plain], 0, len(found) - len(plain)


EXTRACTED = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_tree", pa.int64()), ("n_prior", pa.int64())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for page, low in zip(b.column("html").to_pylist(), b.column("low").to_pylist(), strict=True):
            texts, by_tree, by_prior = main_blocks(page or "", {x["node"]: (x["composite"], x["top"]) for x in low or ()})
            rows.append(("\n".join(texts), by_tree, by_prior))
        made = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url").cast(pa.string()), *(pa.array(c, f.type) for c, f in zip(made, list(EXTRACTED)[2:], strict=True))], schema=EXTRACTED)
        give_back()


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for key, site, page in zip(b.column("key").to_pylist(), b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            rows += [(key, site, n) for n in {node for _, node, _, _ in named(blocks(page or "")[0])}]
        cols = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64()), strict=True)], names=["key", "host", "node"])


def with_weak_nodes(p: DataFrame, low: DataFrame, few: int = BROADCAST_NODES) -> DataFrame:
    """Adds ``low`` to pages: the weak nodes of their hosts (host, node,
    composite, top) together while they are ``few``, else those on the page,
    met by node and by one of ``SALT`` parts of the pages."""
    each = F.struct("node", "composite", "top")
    if low.count() <= few:
        return p.join(F.broadcast(low.groupBy("host").agg(F.collect_list(each).alias("low"))), "host", "left")
    keyed = p.withColumn("key", F.xxhash64("host", "html"))
    part = F.pmod(F.hash("key"), F.lit(SALT)).alias("part")
    on_page = keyed.select("key", "host", "html").mapInArrow(_nodes, "key long, host string, node long").distinct().select("*", part)
    dealt = low.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    own = on_page.join(dealt, ["host", "node", "part"]).groupBy("key").agg(F.collect_list(each).alias("low"))
    return keyed.join(own, "key", "left").drop("key")


def extract(pages: DataFrame, few: int = BROADCAST_NODES) -> DataFrame:
    """page_id, url, text, n_tree and n_prior (blocks that went and that the tree
    alone removes, and that went only with the priors): a row for each row.

    Null or empty html: empty text. Pages without a host are one host. Repeated
    rows are extracted each on its own. Other columns are ignored. An empty
    table gives no rows.
    """
    p = pages.select(F.col("page_id").cast("long"), "url", "html", host(F.col("url")).alias("host"))
    tree = site_tree(p.select("host", "html"))
    low = cut(tree.filter((F.col("composite") < LEAST) & (F.col("top") < SURE) | F.col("doubted")).select("host", "node", "composite", "top"))
    joined = with_weak_nodes(p, low, few)
    return joined.select("page_id", "url", "html", "low").mapInArrow(_extracted, "page_id long, url string, text string, n_tree long, n_prior long")


def op4_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
