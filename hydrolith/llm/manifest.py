"""A Merkle manifest of a dataset: a tree for each group, a tree over the groups.

A forest is a set of nodes whose parents are not known yet, each keyed by its tree,
level and index. Forests form a commutative monoid: two are merged by their union,
and wherever the siblings of a run are all there (the tree's size tells how many
they are) their parent takes their place. Each task folds its rows into a forest;
rows lie in the order of their leaves, so a task's forest has two nodes a level at
most for a tree that it does not hold whole. ``tree_reduce`` merges neighbouring
forests, ``FAN`` at a time, until each tree is one node.

Nodes of the levels from ``BLOCK_LEVEL`` up are kept for the proofs. A proof's lower
part is in its block of 2 ** BLOCK_LEVEL leaves, which is a group of known size; its
upper part is looked up among the nodes that are kept.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.common import remove, shared_dir, stored, table

#: Forests that one merge takes.
FAN = 16
#: Levels that a block of leaves has by itself.
BLOCK_LEVEL = 10
#: Rows of sizes and offsets up to which they are broadcast (about 60 bytes each).
BROADCAST_ROWS = 200_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

#: What a row of a forest is: a parent that was made, a node without one, a root.
MADE, OPEN, ROOT = 0, 1, 2
FOREST = pa.schema([("part", pa.int64()), ("tree", pa.string()), ("n", pa.int64()), ("level", pa.int32()), ("i", pa.int64()), ("digest", pa.string()), ("kind", pa.int32())])
FOREST_TYPE = "part long, tree string, n long, level int, i long, digest string, kind int"


def joined_hash(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def width(n: int, level: int) -> int:
    """Nodes of a level of the tree over n leaves."""
    return -(-n // (1 << level))


class Forest:
    """Nodes without a parent yet, by tree, level and index. Roots and the parents
    of the levels from ``keep`` on that merges have made are told by ``news``."""

    def __init__(self, keep: int = 0):
        self.nodes: dict[tuple[str, int, int], tuple[int, str]] = {}
        self.told: list[tuple] = []
        self.keep = keep

    def add(self, tree: str, n: int, level: int, i: int, digest: str) -> None:
        """Puts a node in, and every parent whose run of siblings is whole now."""
        while (wide := width(n, level)) > 1:
            other = i ^ 1
            if other >= wide:
                digest = joined_hash(digest)
            elif found := self.nodes.pop((tree, level, other), None):
                digest = joined_hash(digest, found[1]) if other > i else joined_hash(found[1], digest)
            else:
                self.nodes[tree, level, i] = n, digest
                return
            level, i = level + 1, i >> 1
            if level >= self.keep:
                self.told.append((tree, n, level, i, digest, MADE))
        self.told.append((tree, n, level, i, digest, ROOT))

    def merge(self, other: Forest) -> Forest:
        for (tree, level, i), (n, digest) in other.nodes.items():
            self.add(tree, n, level, i, digest)
        self.told += other.told
        return self

    def news(self, part: int) -> list[tuple]:
        rows = [(part, *x) for x in self.told]
        self.told.clear()
        return rows

    def rows(self, part: int) -> list[tuple]:
        return self.news(part) + [(part, tree, n, level, i, digest, OPEN) for (tree, level, i), (n, digest) in self.nodes.items()]


def _planted(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[pa.RecordBatch]:
    """Forests of the leaves (part, tree, n, i, digest), one for each part."""
    forest, at, rows = Forest(keep), 0, []
    for b in batches:
        for part, tree, n, i, digest in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if part != at:
                rows += forest.rows(at)
                forest, at = Forest(keep), part
            if not keep:
                forest.told.append((tree, n, 0, i, digest, MADE))
            forest.add(tree, n, 0, i, digest)
        rows += forest.news(at)
        if rows:
            yield _record(rows)
            rows = []
    if rows := forest.rows(at):
        yield _record(rows)


def _record(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), FOREST, strict=True)], schema=FOREST)


def tree_reduce(leaves: DataFrame, parts: int, keep: int, base: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of the levels from ``keep`` on and the roots of the trees over the
    leaves (part, tree, n, i, digest), each (tree, n, level, i, digest)."""

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        forest = Forest(keep)
        for r in rows.itertuples(index=False):
            forest.add(r.tree, r.n, r.level, r.i, r.digest)
        return pd.DataFrame(forest.rows(int(rows["part"].iloc[0]) // FAN), columns=FOREST.names)

    first = leaves.select("part", "tree", "n", "i", "digest").mapInArrow(lambda it: _planted(it, keep), FOREST_TYPE)
    rounds = [stored(first, f"{base}/forest-0")]
    while parts:  # a part may be read by more than one task, so one round at least
        next_ = rounds[-1].filter(F.col("kind") == OPEN).groupBy(F.shiftright("part", FAN.bit_length() - 1)).applyInPandas(merged, FOREST_TYPE)
        rounds.append(stored(next_, f"{base}/forest-{len(rounds)}"))
        parts = -(-parts // FAN) if parts > 1 else 0
    every = reduce(DataFrame.union, rounds)
    of = lambda kind: every.filter(F.col("kind") == kind).select("tree", "n", "level", "i", "digest")
    return of(MADE), of(ROOT)


def numbered(rows: DataFrame, tree: str, order: list[str], base: str, few: int = BROADCAST_ROWS) -> tuple[DataFrame, int]:
    """Adds part, n (rows of the row's tree) and i (its place there, from 0, by
    ``order``), and gives the number of parts. Rows are sorted by ranges and counted
    by parts, so no task holds a tree; equal rows are parted, too."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(tree, *order, "_tie").sortWithinPartitions(tree, *order, "_tie").drop("_tie")
    ranged = stored(dealt.withColumn("_row", F.monotonically_increasing_id()), f"{base}/sorted")
    ranged = ranged.select("*", F.shiftright("_row", 33).alias("part"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).drop("_row")
    counts = ranged.groupBy(F.col("part").alias("_part"), F.col(tree).alias("_tree")).agg(F.count("*").alias("_k"), F.min("_at").alias("_from"))
    over = Window.partitionBy("_tree")
    before = F.coalesce(F.sum("_k").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = stored(counts.select("_part", "_tree", F.sum("_k").over(over).alias("n"), (before - F.col("_from")).alias("_shift")), f"{base}/counts")
    met = (F.col("part") == F.col("_part")) & (F.col(tree) == F.col("_tree"))
    joined = ranged.join(F.broadcast(counts) if counts.count() <= few else counts, met)
    last = counts.agg(F.max("_part")).first()[0]
    return joined.withColumn("i", F.col("_at") + F.col("_shift")).drop("_part", "_tree", "_shift", "_at"), 0 if last is None else last + 1


def height(n: Column) -> Column:
    """Levels over the leaves of a tree: the binary digits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def siblings(nodes: DataFrame, keep: int) -> DataFrame:
    """tree, i, n and path of each node of the level ``keep``: the other children of
    the nodes above it, from the bottom up, as L or R (their side) and digest, or
    empty where a parent has one child."""
    start = nodes.filter(F.col("level") == keep).select("tree", "n", "i")
    levels = F.when(height(F.col("n")) > keep, F.sequence(F.lit(keep), height(F.col("n")) - 1))
    asked = start.withColumn("level", F.explode_outer(levels)).withColumn("other", F.expr(f"shiftright(i, level - {keep}) ^ 1"))
    known = nodes.select("tree", "level", F.col("i").alias("other"), "digest")
    step = F.coalesce(F.concat(F.when(F.col("other") % 2 == 0, "L").otherwise("R"), "digest"), F.lit(""))
    steps = F.collect_list(F.when(F.col("level").isNotNull(), F.struct("level", step.alias("s"))))
    found = asked.join(known, ["tree", "level", "other"], "left").groupBy("tree", "i", "n").agg(F.sort_array(steps).alias("p"))
    return found.select("tree", "i", "n", F.col("p.s").alias("path"))


def fold(digest: str, path: list[str]) -> str:
    """The root that a leaf and its path give."""
    for step in path:
        digest = joined_hash(step[1:], digest) if step[:1] == "L" else joined_hash(digest, step[1:])
    return digest


@dataclass
class Manifest:
    """leaves (tree, doc_id, digest, changed, n, i), nodes and subroots of the
    groups' trees, and of the tree over these: tree, i, path, digest, root."""

    leaves: DataFrame
    nodes: DataFrame
    subroots: DataFrame
    top: DataFrame


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256)


def manifest(docs: DataFrame, changes: dict[str, Column] | None = None, changed: Column | None = None) -> Manifest:
    """The manifest of documents, one tree for each language. Leaves ascend by
    doc_id, null first, equal ids by their hashes. Where ``changed`` holds, leaves
    have a second hash, of the row with ``changes``. Other columns are ignored. An
    empty table has no nodes."""
    base = f"{shared_dir(docs.sparkSession)}/manifest-{uuid.uuid4().hex}"
    own = {c: F.col(c) for c in FIELDS}
    other = F.when(changed, leaf(own | changes)) if changed is not None else F.lit(None).cast("string")
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))  # null before all, in the order of bytes
    leaves = stored(docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(own).alias("digest"), other.alias("changed")), f"{base}/leaves")
    leaves, parts = numbered(leaves, "tree", ["doc_id", "digest"], f"{base}/trees")
    remove(docs.sparkSession, f"{base}/leaves")
    nodes, roots = tree_reduce(leaves, parts, BLOCK_LEVEL, f"{base}/trees")
    groups, parts = numbered(roots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), "tree", ["group"], f"{base}/top")
    above, root = tree_reduce(groups, parts, 0, f"{base}/top")
    paths = siblings(above, 0).select("i", "path")
    top = groups.join(paths, "i").join(F.broadcast(root.select("tree", F.col("digest").alias("root"))), "tree")  # one row
    top = stored(top.select(F.col("group").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), f"{base}/groups")
    return Manifest(leaves, nodes, roots, top)


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proved(leaves: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
    """Proofs of the leaves of one block; ``over`` is one row: the path from the
    block's node to the root, and the roots."""
    leaves = leaves.sort_values("i")
    o = over.iloc[0]
    n, upper = int(o["n"]), list(o["path"])
    levels = [leaves["digest"].tolist()]
    while len(levels) <= BLOCK_LEVEL and width(n, len(levels) - 1) > 1:
        below = levels[-1]
        levels.append([joined_hash(*below[k : k + 2]) for k in range(0, len(below), 2)])
    rows = []
    for k, (digest, changed) in enumerate(zip(levels[0], leaves["changed"], strict=True)):
        path = []
        for at, nodes in enumerate(levels[:-1]):
            j = (k >> at) ^ 1
            path.append("" if j >= len(nodes) else f"{'R' if j % 2 else 'L'}{nodes[j]}")
        path += upper
        folded = fold(changed or digest, path)
        rows.append((digest, o["subroot"], o["root"], joined_hash(*(s[1:] for s in path)), folded, folded == o["root"]))
    out = pd.DataFrame(rows, columns=["leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    out.insert(0, "doc_id", leaves["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None))
    return out


def proofs(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256 (of the siblings from the leaf to
    the root), folded_root (from the leaf's second hash where it has one) and
    verified (whether that is the root): a row for each leaf."""
    small = m.subroots.filter(F.col("level") < BLOCK_LEVEL).select("tree", F.lit(0).cast("long").alias("i"), "n", F.array().cast("array<string>").alias("path"))
    blocks = siblings(m.nodes, BLOCK_LEVEL).union(small)
    over = blocks.join(m.top.withColumnRenamed("path", "rest"), "tree").select("tree", F.col("i").alias("block"), "n", F.concat("path", "rest").alias("path"), "subroot", "root")
    leaves = m.leaves.select("tree", F.shiftright("i", BLOCK_LEVEL).alias("block"), "i", "doc_id", "digest", "changed")
    return leaves.groupBy("tree", "block").cogroup(over.groupBy("tree", "block")).applyInPandas(_proved, PROVED)


def op13_merkle_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    drawn = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return proofs(manifest(docs, {"n_chars": F.col("n_chars") + 1}, drawn))


_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE CAST(octet_length(encode(CAST({0} AS VARCHAR))) AS VARCHAR) || ':' || CAST({0} AS VARCHAR) END"


def _leaf_sql(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(n_chars if c == "n_chars" else c) for c in FIELDS) + ")"


#: DuckDB has no CRC-32, so the polynomial's table is written out by its rule.
_CRC_SQL = """bits AS (SELECT list(CAST(c AS UBIGINT) ORDER BY b) AS t FROM (SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), list_transform(range(8), lambda k: CAST(0 AS UBIGINT))), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, CAST(3988292384 AS UBIGINT)) ELSE x >> 1 END) AS c FROM range(256) r(b)))"""

_TREE = """
{0} AS (
  SELECT tree, 0 AS level, i, n, digest FROM {1}
  UNION ALL
  SELECT tree, level + 1, i // 2, (n + 1) // 2, sha256(digest || coalesce(nxt, '')) FROM (SELECT *, lead(digest) OVER (PARTITION BY tree ORDER BY i) AS nxt FROM {0} WHERE n > 1) WHERE i % 2 = 0)"""

SQL = f"""
WITH RECURSIVE {_CRC_SQL},
docs AS (SELECT coalesce('=' || lang, '') AS tree, doc_id, {_leaf_sql("n_chars")} AS leaf, {_leaf_sql("n_chars + 1")} AS other,
  xor(list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) AS UBIGINT))), lambda x, c: xor(x >> 8, t[CAST(xor(x, c) % 256 AS BIGINT) + 1])), CAST(4294967295 AS UBIGINT)) % 7 = 0 AS drawn FROM documents, bits),
leaves AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY tree) AS n, leaf AS digest FROM docs WINDOW w AS (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf)),{_TREE.format("nodes", "leaves")},
subs AS (SELECT '' AS tree, tree AS grp, digest, row_number() OVER (ORDER BY tree) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),{_TREE.format("upper", "subs")},
steps AS (
  SELECT l.tree, l.i, p.level, CASE WHEN s.i % 2 = 0 THEN 'L' ELSE 'R' END AS side, s.digest FROM leaves l JOIN nodes p ON p.tree = l.tree AND p.n > 1 AND p.i = l.i >> p.level LEFT JOIN nodes s ON s.tree = p.tree AND s.level = p.level AND s.i = xor(p.i, 1)
  UNION ALL
  SELECT l.tree, l.i, 1000 + p.level, CASE WHEN s.i % 2 = 0 THEN 'L' ELSE 'R' END, s.digest FROM leaves l JOIN subs g ON g.grp = l.tree JOIN upper p ON p.n > 1 AND p.i = g.i >> p.level LEFT JOIN upper s ON s.level = p.level AND s.i = xor(p.i, 1)),
paths AS (SELECT tree, i, list(CASE WHEN digest IS NULL THEN '' ELSE side || digest END ORDER BY level) AS path, sha256(coalesce(string_agg(digest, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY tree, i),
folded AS (SELECT l.doc_id, l.leaf, g.digest AS subroot, r.digest AS root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
  list_reduce(list_prepend(CASE WHEN coalesce(l.drawn, false) AND l.other IS NOT NULL THEN l.other ELSE l.leaf END, coalesce(p.path, [])), lambda d, s: CASE WHEN s[1] = 'L' THEN sha256(s[2:] || d) ELSE sha256(d || s[2:]) END) AS folded_root
  FROM leaves l JOIN subs g ON g.grp = l.tree JOIN upper r ON r.n = 1 LEFT JOIN paths p ON p.tree = l.tree AND p.i = l.i)
SELECT *, folded_root = root AS verified FROM folded
"""
