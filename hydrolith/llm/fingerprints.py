"""Document fingerprints: SimHash by weighted votes, and search by block tables.

Built-in functions only. Terms are pairs of neighbouring lower-cased words (the
last word also alone); a term weighs its code points, 16 at most.
"""

from __future__ import annotations

from collections import Counter
from itertools import accumulate, combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import cut, row_hash, table, text_or_empty, words
from hydrolith.llm.simhash import hex16, likeness, signed, vote

#: Stands for a null id in sort orders and join keys.
NO_ID = -(1 << 63)
#: Ids that are ordered together, and ranges at least.
RANGE_ROWS, MIN_RANGES = 4_000_000, 256
#: The search: bits that may differ, and blocks of its tables.
RADIUS, RADIUS_BLOCKS = 2, 5
#: Documents whose id this divides are the search's queries.
QUERY_EVERY = 20


def terms(words_col: str) -> Column:
    w = F.col(words_col)
    pair = lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1)).alias("h"), F.least(F.lit(16), F.length(x) + F.coalesce(F.length(F.get(w, i + 1)), F.lit(0))).alias("w"))
    return F.when(F.size(w) > 0, F.transform(w, pair))


def fingerprint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys, copies, weight, fingerprint; see ``simhash.vote`` for repeated keys.

    A null, empty or blank text has the fingerprint zero.
    """
    w = rows.select(*keys, words(F.lower(F.col(text))).alias("_w"))
    return vote(w.select(*keys, terms("_w").alias("_t")), keys, "_t", weighted=True)


def range_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    b = F.lit(bounds).cast("array<bigint>")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    take = lambda acc, s: acc + F.when(F.coalesce(F.get(b, acc + s - 1) <= value, F.lit(False)), s).otherwise(0)
    return F.aggregate(F.lit(steps), F.lit(0), take)


def ranges_of(ids: DataFrame) -> tuple[Column, int]:
    """The number of the range that a row (k, h) of ``ids`` falls into, in order,
    and how many ranges there are: one for each ``RANGE_ROWS`` rows, by
    approximate quantiles of k. An id that fills ranges alone (as null does) is
    parted by the leading bits of h."""
    n = ids.count()
    many = max(MIN_RANGES, -(-n // RANGE_ROWS))
    cuts = ids.agg(F.percentile_approx("k", F.lit([i / many for i in range(1, many)]), F.lit(10 * many))).first()[0] or []
    often = Counter(cuts)
    hot = {k: (often[k] + 1).bit_length() for k in often if often[k] > 1}
    bounds = sorted({*cuts, *(k + 1 for k in hot if k + 1 < 1 << 63)})
    # Range i begins at bounds[i - 1]; that of a hot id holds no other.
    bits = [0, *(hot.get(k, 0) for k in bounds)]
    first = list(accumulate((1 << x for x in bits), initial=0))
    at = range_of(F.col("k"), bounds)
    table = lambda x: F.lit(x).cast("array<bigint>")
    own = F.get(table(bits), at).cast("int")
    part = F.when(own > 0, F.call_function("shiftrightunsigned", F.col("h").bitwiseXOR(F.lit(NO_ID)), 64 - own)).otherwise(F.lit(0).cast("long"))
    return F.get(table(first[:-1]), at) + part, first[-1]


def successors(ids: DataFrame) -> DataFrame:
    """(k, h) with the next pair (nk, nh) in order; the first follows the last.

    ``ids`` has one row per pair. No task sorts more than a range, and the
    first pairs of the ranges (a row for each, read by the driver) link one to
    the next.
    """
    number, many = ranges_of(ids)
    r = ids.withColumn("_r", number.cast("int"))
    firsts = {x["_r"]: x["f"] for x in r.groupBy("_r").agg(F.min(F.struct("k", "h")).alias("f")).collect()}
    # The first pair of the next range that has one, for each range by number.
    after, nxt = [(None, None)] * many, firsts[min(firsts)] if firsts else (None, None)
    for i in range(many - 1, -1, -1):
        after[i] = nxt
        nxt = firsts.get(i, nxt)
    k, h = (F.lit([x[j] for x in after]).cast("array<bigint>") for j in (0, 1))
    w = Window.partitionBy("_r").orderBy("k", "h")
    out = r.withColumn("_n", F.lead(F.struct("k", "h")).over(w))
    return out.select(*ids.columns, F.coalesce("_n.k", F.get(k, F.col("_r"))).alias("nk"), F.coalesce("_n.h", F.get(h, F.col("_r"))).alias("nh"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each text, its edited text (the last quarter replaced by the beginning
    of the next document) and their fingerprints; a row for each row.

    Order: doc_id, null first, then the text's hash. Null text: empty. Rows
    that repeat both id and text are one document with as many result rows.
    A single document is its own next one.
    """
    d = docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("k"), row_hash(F.col("text")).alias("h"), text_or_empty("text").alias("t"))
    n = F.length("t")
    ids = cut(d.groupBy("k", "h").agg(F.max(n).alias("n"), F.count("*").alias("rows")))
    order = successors(ids)
    # The beginning that the document before needs, and no more, goes to it.
    wanted = order.select(F.col("nk").alias("k"), F.col("nh").alias("h"), F.col("k").alias("pk"), F.col("h").alias("ph"), F.floor(F.col("n") / 4).cast("int").alias("q"))
    heads = d.join(wanted, ["k", "h"]).select(F.col("pk").alias("k"), F.col("ph").alias("h"), F.left("t", "q").alias("head")).groupBy("k", "h").agg(F.max("head").alias("head"))
    both = d.join(heads, ["k", "h"]).withColumn("e", F.concat(F.substring("t", F.lit(1), n - F.floor(n / 4).cast("int")), F.col("head")))
    texts = both.select("k", "h", F.sha2(F.col("e").cast("binary"), 256).alias("sha"), F.posexplode(F.array("t", "e")).alias("which", "x"))
    # Stored (about 100 bytes a document), as it is joined with itself below.
    found = cut(
        fingerprint(texts, ["k", "h", "which", "sha"], "x").groupBy("k", "h").agg(
            F.max("sha").alias("edited_sha256"), F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("f"), F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("g")
        )
    )
    known = order.join(found, ["k", "h"]).join(near(found.join(order.select("k", "h", "rows"), ["k", "h"])), ["k", "h"], "left")
    after = found.select(F.col("k").alias("nk"), F.col("h").alias("nh"), F.col("f").alias("nf"))
    return known.join(after, ["nk", "nh"]).withColumn("_r", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))


def block_masks(radius: int, blocks: int, bits: int = 64) -> list[int]:
    """Masks of all choices of ``blocks - radius`` blocks: two fingerprints
    within the radius agree on every bit of one of them at least."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    masks = [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def find_within(queries: DataFrame, corpus: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (query, fingerprint, bits): distinct fingerprints of ``corpus``
    within ``radius`` bits of distinct ones of ``queries``.

    Both frames have a long ``fingerprint``; nulls are left out. Other columns of
    ``corpus`` come along, and its fingerprints must then be distinct. Each table
    permutes one choice of blocks to the front as the join key; a pair counts
    in the first table that it meets in, so no pair comes twice. More blocks
    make longer keys: take them so that 2**(bits of a key) exceeds the corpus.
    """
    if not 0 <= radius < blocks:
        raise ValueError("radius must be less than blocks")
    masks = block_masks(radius, blocks)
    tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).alias("m")) for i, m in enumerate(masks)])

    more = [c for c in corpus.columns if c != "fingerprint"]

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.select(F.col("fingerprint").alias(name), *(more if name == "fingerprint" else ())).filter(F.col(name).isNotNull())
        one = one if more and name == "fingerprint" else one.distinct()
        return one.withColumn("x", F.explode(tables)).select("*", F.col("x.t").alias("t"), F.col(name).bitwiseAND(F.col("x.m")).alias("key")).drop("x")

    x = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(x.bitwiseAND(F.lit(m)) == 0, F.lit(i)) for i, m in enumerate(masks)])
    pairs = keyed(queries, "query").join(keyed(corpus, "fingerprint"), ["t", "key"])
    return pairs.filter((F.bit_count(x) <= radius) & (first == F.col("t"))).select("query", "fingerprint", F.bit_count(x).alias("bits"), *more)


def near(known: DataFrame) -> DataFrame:
    """k, h and ``n_within``, for ids that ``QUERY_EVERY`` divides: how many other
    documents have a fingerprint within ``RADIUS`` bits. ``known`` has k, h, f and
    rows. Equal fingerprints are searched once, so copies make no pairs."""
    asks = known.filter((F.pmod("k", F.lit(QUERY_EVERY)) == 0) & (F.col("k") != NO_ID)).select("k", "h", "f")
    each = known.groupBy(F.col("f").alias("fingerprint")).agg(F.sum("rows").alias("_n"))
    found = find_within(asks.select(F.col("f").alias("fingerprint")), each, RADIUS, RADIUS_BLOCKS)
    total = found.groupBy(F.col("query").alias("f")).agg((F.sum("_n") - 1).alias("n_within"))
    return asks.join(total, "f").select("k", "h", "n_within")


def op3_document_fingerprints(spark, sf_dir):
    e = edited_fingerprints(table(spark, sf_dir, "documents"))
    return e.select(
        F.when(F.col("k") != NO_ID, F.col("k")).alias("doc_id"),
        F.col("n").cast("long").alias("n_chars"),
        "edited_sha256",
        hex16(F.col("f")).alias("fingerprint"),
        hex16(F.col("g")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("g")).alias("near_edited"),
        likeness(F.col("f"), F.col("nf")).alias("near_next"),
        "n_within",
    )


__all__ = ["block_masks", "edited_fingerprints", "find_within", "fingerprint", "op3_document_fingerprints", "near", "range_of", "ranges_of", "signed", "successors", "terms"]
