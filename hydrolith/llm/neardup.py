"""SimHash near-duplicates by a binary trie joined with itself.

Fingerprints that differ in two bits at most agree on all bits of four of six
blocks. Each choice of four is a subtree of a trie whose bits are permuted so
that these come first; subtrees are dealt over the cluster. In a subtree, pairs
of nodes go down together and are dropped once they differ in more bits than
allowed. A subtree leaves 22 free bits at most, which bounds it to 2**22
fingerprints (32 MB), however large a group of near copies is. Equal
fingerprints are one leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import cut, row_hash, table, words
from hydrolith.llm.components import components
from hydrolith.llm.fingerprints import NO_ID, block_masks
from hydrolith.llm.simhash import hex16, vote

BITS = 2
BLOCKS = 6
#: Node pairs of a trie that are taken down together (about 33 bytes each, and their children).
FRONTIER = 1_000_000


def shingle_hashes(docs: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """keys and ``terms``: XXH64 (seed 42) of each run of ``size`` words joined
    by spaces; of the whole sequence if it is shorter; none for a blank text.
    Only A-Z are lower-cased."""
    small = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    w = docs.select(*keys, words(small).alias("_w"))
    n = F.size("_w")
    whole = F.array(F.xxhash64(F.array_join("_w", " ")))
    run = lambda x, i: F.xxhash64(F.concat_ws(" ", x, *[F.get("_w", i + F.lit(k)) for k in range(1, size)]))
    inner = F.transform(F.slice("_w", F.lit(1), F.greatest(n - (size - 1), F.lit(1))), run)
    return w.select(*keys, F.when(n >= size, inner).when(n > 0, whole).alias("terms"))


def trie_pairs(values: np.ndarray, group: np.ndarray, most: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of distinct values of one group that differ in ``most`` bits
    at most. ``values`` (uint64) are sorted within ``group``, which is sorted.

    A node is a range of the sorted values; a level splits it by its next bit.
    Node pairs go down level by level; over ``frontier`` of them part, and one
    part waits, so that a dense group costs time but no more memory.
    """
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.r_[start[1:], len(values)]
    many = end - start > 1
    a0, a1 = start[many], end[many]
    waiting = [(63, a0, a1, a0, a1, np.zeros(len(a0), np.int8))]
    upto: list[np.ndarray | None] = [None] * 64
    while waiting:
        bit, a0, a1, b0, b1, err = waiting.pop()
        if not len(a0):
            continue
        if len(a0) > frontier:
            half = len(a0) // 2
            waiting += [(bit, *(x[part] for x in (a0, a1, b0, b1, err))) for part in (slice(None, half), slice(half, None))]
            continue
        if bit < 0:
            different = a0 != b0
            yield a0[different], b0[different]
            continue
        ones = upto[bit]
        if ones is None:
            ones = upto[bit] = np.r_[0, np.cumsum((values >> np.uint64(bit)) & np.uint64(1), dtype=np.int32)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = a0 == b0
        parts = [(a0, am, b0, bm, err), (am, a1, bm, b1, err), (a0, am, bm, b1, err + 1)]
        other = ~own
        parts.append((am[other], a1[other], b0[other], bm[other], err[other] + 1))
        a0, a1, b0, b1, err = (np.concatenate(x) for x in zip(*parts, strict=True))
        live = (a1 > a0) & (b1 > b0) & (err <= most) & ~((a0 == b0) & (a1 - a0 == 1))
        waiting.append((bit - 1, *(x[live] for x in (a0, a1, b0, b1, err))))


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    """Of the pairs of indices below n, those that join two parts: links enough
    for components. Pairs within one part are left out all at once."""
    up = np.arange(n)

    def root(x: int) -> int:
        while (p := int(up[x])) != x:
            up[x] = x = int(up[p])
        return x

    out = []
    for a, b in pairs:
        while ((higher := up[up]) != up).any():
            up[:] = higher
        apart = up[a] != up[b]
        for x, y in zip(a[apart].tolist(), b[apart].tolist(), strict=True):
            if (r := root(x)) != (s := root(y)):
                up[max(r, s)] = min(r, s)
                out.append((x, y))
    return out


def _join(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    def links(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(f=p["fp"].to_numpy().view(np.uint64)).sort_values(["t", "key", "f"], kind="stable")
        t, key, f = p["t"].to_numpy(), p["key"].to_numpy(), p["f"].to_numpy()
        group = np.cumsum(np.r_[False, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        joined = np.array(forest(len(f), trie_pairs(f, group, most)), np.int64).reshape(-1, 2)
        signed = f.view(np.int64)
        return pd.DataFrame({"a": signed[joined[:, 0]], "b": signed[joined[:, 1]]})

    rest: list[pd.DataFrame] = []
    for p in batches:
        if not len(p):
            continue
        last = (p["t"] == p["t"].iloc[-1]) & (p["key"] == p["key"].iloc[-1])
        if not last.all():
            yield links(pd.concat([*rest, p[~last]]))
            rest = []
        elif rest and (rest[-1]["key"].iloc[-1], rest[-1]["t"].iloc[-1]) != (p["key"].iloc[0], p["t"].iloc[0]):
            yield links(pd.concat(rest))
            rest = []
        rest.append(p[last])
    if rest:
        yield links(pd.concat(rest))


def linked(fingerprints: DataFrame, most: int = BITS, blocks: int = BLOCKS) -> DataFrame:
    """Links (a, b) between distinct long ``fp`` that give the components of
    all pairs within ``most`` bits."""
    masks = F.array(*[F.struct(F.lit(i).cast("byte").alias("t"), F.lit(m).alias("m")) for i, m in enumerate(block_masks(most, blocks))])
    subtrees = fingerprints.select("fp", F.explode(masks).alias("x")).select(F.col("x.t").alias("t"), F.col("fp").bitwiseAND(F.col("x.m")).alias("key"), "fp")
    dealt = subtrees.repartition("t", "key").sortWithinPartitions("t", "key")
    return dealt.mapInPandas(lambda it: _join(it, most), "a long, b long")


def near_duplicates(docs: DataFrame, size: int = 3, most: int = BITS) -> DataFrame:
    """k (the id; NO_ID for null), h (the text's hash), copies, fp, root, component.

    One row for each pair of id and text, with how many rows have it. A group
    is all rows of one ``root`` (its least fingerprint); ``component`` is the
    least id in it, NO_ID if none has an id. An id that stands on texts of two
    groups can name both. Null and blank texts have the fingerprint zero and
    are linked like any other.
    """
    d = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k"), row_hash(F.col("text")).alias("h"), "text")
    voted = vote(shingle_hashes(d, ["k", "h"], "text", size), ["k", "h"], "terms")
    rows = cut(voted.select("k", "h", "copies", F.col("fingerprint").alias("fp")))
    distinct = cut(rows.groupBy("fp").agg(F.min(F.when(F.col("k") != NO_ID, F.col("k"))).alias("least")))
    roots = components(linked(distinct, most)).withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.coalesce(F.min("least"), F.lit(NO_ID)).alias("component"))
    of = rooted.join(least, "root").select("fp", "root", "component")
    return rows.join(of, "fp")


def deduplicated(docs: DataFrame, size: int = 3, most: int = BITS) -> DataFrame:
    """One row of ``docs`` for each group: of its least id (null if none has an
    id), and of that id's texts in the group the one of the least hash."""
    keep = near_duplicates(docs, size, most).filter("k = component").groupBy("root", "k").agg(F.min("h").alias("h")).drop("root")
    k = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    own = docs.select(k.alias("k"), row_hash(F.col("text")).alias("h"), F.struct("*").alias("row"))
    return own.join(keep, ["k", "h"]).dropDuplicates(["k", "h"]).select("row.*")


def op10_simhash_near_dedup(spark, sf_dir):
    n = near_duplicates(table(spark, sf_dir, "documents"))
    id_of = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    each = n.withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select(id_of("k").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), id_of("component").alias("component_id"))
