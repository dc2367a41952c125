"""Vector codes: each part of a vector is named by its nearest codebook entry.

Codebooks are refined by whole-table rounds. A task finds the nearest entries by
partial-distance search: entries are met from the vector's place on the dimension
that varies most in the codebook outward, a few at a time; dimensions are added
in the order of their variance, and a mask drops an entry as soon as what has been
added exceeds the least whole distance met so far. All numbers are integers, so
results do not depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import cut, small_batches, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries that are met at once.
BLOCK = 8
#: Labels up to which their sums are broadcast (about 20 bytes each).
BROADCAST_LABELS = 200_000

CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("code", pa.string()), ("error", pa.int64())])


def largest(dimension: int) -> int:
    """The size up to which integer components are told apart: squared distances
    of whole vectors then fit a long."""
    return isqrt((2**63 - 1) // (4 * max(1, dimension)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` for each row of ``x``, the lower one
    of equals, and its squared distance."""
    n, k = len(x), len(book)
    if not book.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    wide = np.argsort(-book.astype(np.float64).var(axis=0), kind="stable")
    x, c = x[:, wide], book[:, wide]
    along = np.argsort(c[:, 0], kind="stable")
    place = np.searchsorted(c[along, 0], x[:, 0])
    outward = np.array([(i + 1) // 2 * (-1 if i % 2 else 1) for i in range(k)])
    least, index = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
    for at in range(0, k, BLOCK):
        entry = along[(place[:, None] + outward[at : at + BLOCK]) % k]
        sums = (x[:, :1] - c[entry, 0]) ** 2
        row, column = np.nonzero(sums <= least[:, None])
        entry, sums = entry[row, column], sums[row, column]
        for j in range(1, x.shape[1]):
            sums = sums + (x[row, j] - c[entry, j]) ** 2
            alive = sums <= least[row]
            row, entry, sums = row[alive], entry[alive], sums[alive]
        if not len(row):
            continue
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        shortest = np.minimum.reduceat(sums, first)
        lowest = np.minimum.reduceat(np.where(sums == np.repeat(shortest, np.diff(np.r_[first, len(row)])), entry, k), first)
        of = row[first]
        better = (shortest < least[of]) | (shortest == least[of]) & (lowest < index[of])
        least[of[better]], index[of[better]] = shortest[better], lowest[better]
    return index, least


def whole(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows of a batch have a vector without null, infinite or undefined
    components, their components one after another, and their lengths."""
    lists = batch.column("embedding")
    lists = lists.cast(pa.large_list(pa.float64()))
    length = np.where(lists.is_valid().to_numpy(zero_copy_only=False), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.r_[0, np.cumsum(length)]
    bad = np.r_[0, np.cumsum(~np.isfinite(values))]
    good = lists.is_valid().to_numpy(zero_copy_only=False) & (bad[ends[1:]] == bad[ends[:-1]])
    return np.flatnonzero(good), values[np.repeat(good, length)], length[good]


def integers(values: np.ndarray, length: np.ndarray, dimension: int) -> np.ndarray:
    """Rows of ``dimension`` integers, short vectors filled with zeros."""
    most = largest(dimension)
    out = np.zeros((len(length), dimension), np.int64)
    out[np.arange(dimension) < length[:, None]] = np.clip(np.floor(values * SCALE), -most, most).astype(np.int64)
    return out


def _first(batches: Iterator[pa.RecordBatch], entries: int) -> Iterator[pa.RecordBatch]:
    """A task's first ``entries`` vectors and the longest length it met."""
    best: list[tuple[bool, int, list[float]]] = []
    longest = 0
    for b in batches:
        rows, values, length = whole(b)
        ends = np.r_[0, np.cumsum(length)]
        longest = max(longest, int(length.max(initial=0)))
        ids = b.column("vec_id").take(pa.array(rows)).to_pylist()
        edge = best[-1][:2] if len(best) == entries else (True, 2**63)
        best += [(i is None, i or 0, values[ends[k] : ends[k + 1]].tolist()) for k, i in enumerate(ids) if (i is None, i or 0) <= edge]
        best = sorted(best)[:entries]
    if best:
        yield pa.RecordBatch.from_arrays([pa.array([None if none else i for none, i, _ in best], pa.int64()), pa.array([v for *_, v in best], pa.list_(pa.float64())), pa.array([longest] * len(best), pa.int32())], names=["vec_id", "v", "longest"])


def _split(batch: pa.RecordBatch, books: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows with a whole vector, and these vectors part by part."""
    rows, values, length = whole(batch)
    x = integers(values, length, books.shape[0] * books.shape[2])
    return rows, np.split(x, books.shape[0], axis=1)


def _sums(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A task's componentwise sums and numbers of the parts of each entry."""
    total, count = np.zeros_like(books), np.zeros(books.shape[:2], np.int64)
    for b in batches:
        for p, x in enumerate(_split(b, books)[1]):
            index, _ = nearest(x, books[p])
            np.add.at(total[p], index, x)
            count[p] += np.bincount(index, minlength=books.shape[1])
    used = np.argwhere(count)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.array(used[:, 0], pa.int32()), pa.array(used[:, 1], pa.int32()), pa.array(count[tuple(used.T)]), pa.array(total[tuple(used.T)].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])


def refined(vectors: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: the driver gets one row for each entry."""
    parts = vectors.mapInArrow(lambda it: _sums(it, books), "part int, entry int, n long, sums array<bigint>")
    sums = [F.sum(F.get("sums", F.lit(j)).cast("decimal(20,0)")).alias(f"s{j}") for j in range(books.shape[2])]
    out = books.copy()
    for r in parts.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r["part"], r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(books.shape[2])]
    return out


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray | None:
    """Codebooks as (part, entry, position), from all rows; None without a vector."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry has two hex digits: 1 to 256 of them")
    first = cut(vectors.mapInArrow(lambda it: _first(it, entries), "vec_id long, v array<double>, longest int"))
    longest = first.agg(F.max("longest")).first()[0]
    if longest is None:
        return None
    size = -(-longest // parts)
    start = first.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    x = integers(np.concatenate([np.asarray(r["v"], np.float64) for r in start]), np.array([len(r["v"]) for r in start]), size * parts)
    books = np.stack(np.split(x, parts, axis=1))
    for _ in range(rounds):
        books = refined(vectors, books)
    return books


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, xs = _split(b, books)
        found = [nearest(x, book) for x, book in zip(xs, books, strict=True)]
        codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8).tobytes().hex()
        wide = 2 * len(books)
        at = pa.array(rows)
        yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("label").take(at), pa.array([codes[k : k + wide] for k in range(0, wide * len(rows), wide)], pa.string()), pa.array(np.sum([d for _, d in found], axis=0, dtype=np.int64))], schema=CODED)


def checksum(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(embeddings: DataFrame, books: np.ndarray | None) -> DataFrame:
    """vec_id, label, code and error of each row that has a whole vector."""
    vectors = _vectors(embeddings)
    if books is None:
        return vectors.selectExpr("vec_id", "label", "'' AS code", "0L AS error").limit(0)
    return vectors.mapInArrow(lambda it: _coded(it, books), "vec_id long, label int, code string, error long")


def _vectors(embeddings: DataFrame) -> DataFrame:
    small_batches(embeddings.sparkSession, 5000)
    return embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), F.col("embedding").cast("array<double>"))


def compress(embeddings: DataFrame, few: int = BROADCAST_LABELS) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256.

    Rows whose vector is null or has a null, infinite or undefined component give
    none. Vectors that are shorter than the longest, or whose length the parts do
    not divide, are filled with zeros. Components count up to ``largest`` in size
    (741,000 before scaling, for 64 dimensions). Codebooks start at the least ids,
    null ids last, repeated ids by their vectors; with fewer vectors than entries
    there are as many entries. Repeated rows are coded each on its own. A sum of
    errors beyond a long is null. An empty table gives no rows.
    """
    books = fit(_vectors(embeddings))
    rows = cut(coded(embeddings, books))
    sums = cut(rows.groupBy(F.col("label").alias("_label")).agg(F.try_sum("error").alias("label_error")))
    sums = F.broadcast(sums) if sums.count() <= few else sums
    sha = checksum(books) if books is not None else ""
    return rows.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def op11_vector_codes(spark, sf_dir):
    return compress(table(spark, sf_dir, "embeddings"))


def _round(k: int) -> str:
    """SQL of one round: the entry of each part, then the entries' means."""
    return f"""
a{k} AS (SELECT s.vec_id, s.label, s.p, s.x, min(CAST(list_sum(list_transform(range(1, len(s.x) + 1), lambda i: (s.x[i] - b.c[i]) * (s.x[i] - b.c[i]))) AS HUGEINT) * 64 + b.k) AS best
  FROM parts s JOIN b{k} b ON b.p = s.p GROUP BY ALL),
m{k} AS (SELECT p, k, list(v ORDER BY i) AS c FROM (SELECT p, k, i, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v FROM (SELECT p, CAST(best % 64 AS BIGINT) AS k, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS i FROM a{k}) GROUP BY p, k, i) GROUP BY p, k),
b{k + 1} AS (SELECT b.p, b.k, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.k = b.k),"""


SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) r(p)),
b0 AS (SELECT p, k, c FROM (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS k, x AS c FROM parts) WHERE k < 64),{_round(0)}{_round(1)}{_round(2)}
last AS (SELECT vec_id, label, string_agg(printf('%02x', CAST(best % 64 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // 64) AS BIGINT) AS error FROM a2 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(v, ',' ORDER BY p, k)) AS codebooks_sha256 FROM (SELECT p, k, array_to_string(c, ',') AS v FROM b2))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM last, books
"""
