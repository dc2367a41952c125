"""Mixing sources to target weights by a multivariate-hypergeometric tree.

A source's documents fall into blocks by hash, about as many at most as the root
of all documents, so that blocks and not documents are counted. A source's target
gives whole passes over its blocks and a part of one more pass in a permuted
order. A tree over the output shards then splits the exact quotas: at each node
the left half draws its blocks without replacement from the node's blocks of
all sources. Sources are dealt to ``GROUPS`` groups by hash; the tree splits the
groups' quotas, and a task deals a group's shares to its sources in a random
order, which is the same law as a tree over sources. A source's permuted order is
cut by its shares into disjoint stretches, one for each shard, and a shard orders
its documents by hash.

The driver sees totals, at most one row for each group, and no source: their
number is free. Targets rise to the common level by sums over all sources.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import GAP, WHITE, cut, row_hash, table

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 20240607
#: Words that an output shard has about, and the shards at least and at most.
SHARD_WORDS = 2_000_000
SHARDS = (64, 65_536)
#: Groups of sources: columns of the driver's table of shards.
GROUPS = 128
#: Blocks of a source: so many, or the root of all documents, at most.
BLOCKS = 4096
#: Documents that a block has at least, while a source has more than one block.
BLOCK_DOCS = 32
#: Rows of the tables of sources and of draws (about 60 bytes each) up to which they are broadcast.
BROADCAST_ROWS = 500_000


def with_targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to a stored frame (_s, source_size): shares of the total by
    repeating weights (sources by code point, null last); what a source would get
    above ``cap`` times its size is shared again by weight.

    Sources are numbered by a distributed sort. The common level (words for a
    weight of 1) rises until no source is above its cap; a round is one sum."""
    spread = sources.orderBy(F.col("_s") == "n", "_s").withColumn("_m", F.monotonically_increasing_id())
    numbered = cut(spread.withColumns({"_p": F.shiftright("_m", 33), "_k": F.col("_m").bitwiseAND((1 << 33) - 1)}).drop("_m"))
    parts = numbered.groupBy("_p").agg(F.count("*").alias("_c"))  # a row for each task of the sort
    before = parts.select("_p", (F.sum("_c").over(Window.orderBy("_p")) - F.col("_c")).alias("_b"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_b") + F.col("_k"), F.lit(len(weights))) + 1).cast("int"))
    w = numbered.join(F.broadcast(before), "_p").withColumn("_w", weight).drop("_p", "_k", "_b")
    full = lambda level: F.lit(level) * F.col("_w") > F.lit(cap) * F.col("source_size")
    level, open_ = 0.0, -1
    while True:
        over = full(level)
        r = w.agg(F.count_if(~over).alias("n"), F.sum(F.when(~over, F.col("_w"))).alias("w"), F.sum(F.when(over, F.col("source_size"))).alias("f"), F.sum("source_size").alias("all")).first()
        if r["n"] in (0, open_):
            break
        open_, level = r["n"], max(0.0, r["all"] - cap * (r["f"] or 0)) / r["w"]
    return w.withColumn("target", F.when(full(level), F.lit(float(cap)) * F.col("source_size")).otherwise(F.lit(level) * F.col("_w"))).drop("_w")


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """(shards, sources) counts whose columns add up to the quotas. A node's
    left half takes half of the node's blocks, drawn without replacement."""

    def node(counts: np.ndarray, lo: int, hi: int) -> list[np.ndarray]:
        if hi - lo == 1:
            return [counts]
        mid = (lo + hi) // 2
        n = int(counts.sum())
        rng = np.random.default_rng([seed, lo, hi])
        share = n * (mid - lo) // (hi - lo) + int(rng.random() < n * (mid - lo) / (hi - lo) % 1)
        left = rng.multivariate_hypergeometric(counts, share, method="marginals") if n else counts
        return node(left, lo, mid) + node(counts - left, mid, hi)

    return np.array(node(np.array(quotas, np.int64), 0, shards))


def n_words(text: Column) -> Column:
    """Words of a text; null: 0."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.lit(0)).otherwise(F.regexp_count(inner, F.lit(GAP)) + 1).cast("long")


def keyed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """_s (the source as a key that is never null), _o (a hash order), row."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    order = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), row_hash(F.col("text")))
    return docs.select(source.alias("_s"), order.alias("_o"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))


def shards_for(words: int) -> int:
    """A power of two of shards of about ``SHARD_WORDS``, within bounds."""
    least, most = SHARDS
    n = least
    while n < most and n * SHARD_WORDS < words:
        n *= 2
    return n


def blocks_for(docs: int) -> int:
    """A power of two: with n documents neither the blocks of a source nor the
    documents of a block are many more than the root of n."""
    n = BLOCKS
    while n * n < docs:
        n *= 2
    return n


def dealt(quotas: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """From (g, _s, quota) and a group's (g, shard, n): _s, pos and shard, where a
    source's shards rise with pos from 0. A group is one task, with a row for
    each block that is taken of its sources."""

    def deal(q: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        q, n = q.sort_values("_s"), n.sort_values("shard")
        size = q["quota"].to_numpy()
        of = np.repeat(np.arange(len(q)), size)
        shard = np.repeat(n["shard"].to_numpy(), n["n"].to_numpy())
        if len(q) > 1:
            shard = np.random.default_rng([seed, int(q["g"].iloc[0])]).permutation(shard)
            shard = shard[np.lexsort((shard, of))]
        pos = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
        return pd.DataFrame({"_s": q["_s"].to_numpy()[of], "pos": pos, "shard": shard.astype(np.int32)})

    return quotas.groupBy("g").cogroup(shares.groupBy("g")).applyInPandas(deal, "_s string, pos long, shard int")


class Draws(NamedTuple):
    """``blocks``: one row for each drawn block, with an array ``draws`` of (epoch,
    shard, upto): of its documents those with _o <= upto are drawn. ``figures``:
    what a document's source has, by ``on``; ``fine`` is what _f is modulo."""

    blocks: DataFrame
    few_blocks: bool
    figures: DataFrame
    on: list[str]
    fine: int
    shards: int


def small(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def draws(sized: DataFrame, weights=WEIGHTS, cap: float = CAP, shards: int | None = None, seed: int = SEED) -> Draws:
    """The draws from a stored frame (_s, _o, size).

    Few sources are broadcast; many are joined by source and hash, so that
    a large source is not one key."""
    spark = sized.sparkSession
    most = blocks_for(sized.count())
    fine = F.pmod("_o", F.lit(most)).cast("int")
    counted = cut(sized.groupBy("_s", fine.alias("_f")).agg(F.count("*").alias("n"), F.sum("size").alias("size")))
    summed = cut(counted.groupBy("_s").agg(F.sum("n").alias("n"), F.sum("size").alias("source_size")))
    few = summed.count() <= BROADCAST_ROWS
    z, t = F.col("source_size"), F.col("target")
    # The greatest power of two of blocks with BLOCK_DOCS documents each, by the length of the binary number.
    power = F.expr(f"CAST(shiftleft(1L, length(bin(CAST(floor(n / {BLOCK_DOCS}) AS BIGINT))) - 1) AS BIGINT)")
    sources = cut(
        with_targets(summed, weights, cap)
        .withColumns({"blocks": F.least(F.lit(most), power).cast("int"), "passes": F.when(z > 0, F.least(F.lit(int(cap)), F.floor(t / z))).otherwise(0).cast("int")})
        .withColumn("rest", F.greatest(F.lit(0.0), t - F.col("passes") * z))
    )
    of_source = small(sources.select("_s", "source_size", "target", "blocks", "passes", "rest"), few)

    fines = counted.join(of_source, "_s").withColumn("block", F.pmod("_f", "blocks"))
    block = fines.groupBy("_s", "blocks", "passes", "rest", "block").agg(F.sum("size").alias("size"))
    order = Window.partitionBy("_s", "epoch").orderBy(F.xxhash64(F.lit(seed + 1), "_s", "epoch", "block"), "block")
    passed = block.withColumn("epoch", F.explode(F.sequence(F.lit(0), "passes"))).withColumns({
        "rank": F.row_number().over(order) - 1,
        "filled": F.count("*").over(Window.partitionBy("_s", "epoch")),
        "before": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    g = F.pmod(F.xxhash64(F.lit(seed + 3), "_s"), F.lit(GROUPS)).cast("int").alias("g")
    taken = cut(passed.filter("epoch < passes OR before < rest").withColumn("pos", F.col("epoch") * F.col("filled") + F.col("rank")))

    shards = shards or shards_for(sized.agg(F.sum("size")).first()[0] or 0)
    quotas = taken.groupBy(g, "_s").agg(F.count("*").alias("quota"))
    of_group = sorted((r["g"], r["q"]) for r in quotas.groupBy("g").agg(F.sum("quota").alias("q")).collect())
    tree = split_tree([q for _, q in of_group], shards, seed)
    at, group = np.nonzero(tree)
    ids = np.array([x for x, _ in of_group], np.int32)
    shares = spark.createDataFrame(pa.table({"g": ids[group], "shard": at.astype(np.int32), "n": tree[at, group]}))
    placed = taken.join(dealt(quotas, shares, seed), ["_s", "pos"])

    last = taken.filter("epoch = passes AND before + size > rest").select("_s", "block", (F.col("rest") - F.col("before")).alias("need"))
    ends = small(fines.select("_s", "_f", "block").join(small(last, few), ["_s", "block"]), few)
    within = Window.partitionBy("_s").orderBy("_o").rangeBetween(Window.unboundedPreceding, 0)  # rows of one block of a source
    inside = sized.withColumn("_f", fine).join(ends, ["_s", "_f"]).withColumn("sum", F.sum("size").over(within))
    ended = inside.groupBy("_s", "block").agg(F.max(F.when(F.col("sum") - F.col("size") / 2 <= F.col("need"), F.col("_o"))).alias("cut"))
    partial = placed.join(small(ended.withColumn("partial", F.lit(True)), few), ["_s", "block"], "left")
    upto = F.when(F.col("partial") & (F.col("epoch") == F.col("passes")), F.col("cut")).otherwise(F.lit((1 << 63) - 1))
    of_block = partial.withColumn("upto", upto).filter("upto IS NOT NULL").groupBy("_s", "block").agg(F.collect_list(F.struct("epoch", "shard", "upto")).alias("draws"))
    figures = sources.select("_s", "source_size", "target", "blocks") if few else fines.select("_s", "_f", "source_size", "target", "blocks")
    return Draws(of_block, sum(q for _, q in of_group) <= BROADCAST_ROWS, small(figures, few), ["_s"] if few else ["_s", "_f"], most, shards)


def drawn(rows: DataFrame, d: Draws) -> DataFrame:
    """Adds to rows with _s and _o their source's figures and ``draws``."""
    r = rows.withColumn("_f", F.pmod("_o", F.lit(d.fine)).cast("int")).join(d.figures, d.on).withColumn("block", F.pmod("_f", "blocks")).drop("_f")
    r = r.join(small(d.blocks, d.few_blocks), ["_s", "block"], "left")
    mine = F.filter(F.coalesce("draws", F.array().cast("array<struct<epoch:int,shard:int,upto:bigint>>")), lambda x: F.col("_o") <= x["upto"])
    return r.withColumn("draws", mine)


def sized(docs: DataFrame) -> DataFrame:
    return keyed(docs).select("row.doc_id", "_s", "_o", n_words(F.col("row.text")).alias("size"))


def mix(docs: DataFrame, shards: int | None = None) -> DataFrame:
    """The mix itself: the columns of ``docs``, as many rows as a document is
    drawn times (none to three), dealt to shards and shuffled inside them.

    Null and empty texts have size 0. Repeated rows are drawn together. A
    source of size 0 has target 0. An empty table gives no rows.
    """
    d = draws(cut(sized(docs)), shards=shards)
    each = drawn(keyed(docs), d).withColumn("_d", F.explode("draws"))
    pos = F.xxhash64(F.lit(SEED + 2), "_o", F.col("_d.epoch"))
    return each.select("row", F.col("_d.shard").alias("shard"), pos.alias("pos")).repartitionById(d.shards, "shard").sortWithinPartitions("shard", "pos").select("row.*")


def op8_source_mixing(spark, sf_dir):
    s = cut(sized(table(spark, sf_dir, "documents")))
    d = drawn(s, draws(s))
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), F.transform("draws", lambda x: x["shard"]).alias("shards"))
