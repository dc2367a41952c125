"""Lines that many documents share, kept once, by levelled sorted runs of hashes.

A line is named by 128 bits of its key. The documents come in batches, the
largest ids first. A batch's keys are sorted and merged against the runs of those
before it; what no run has (an anti-join) is seen here first, so its largest
document keeps it, and it becomes a run of its own. Runs of one level are merged
into one of the next level when there are ``FANOUT`` of them. Only keys of enough
documents enter the runs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.llm.common import WHITE, remove, shared_dir, small_batches, stored, table, text_or_empty

LEAST_CHARS, LEAST_DOCS = 40, 5
BATCHES = 6
#: Runs of a level that are merged into one of the next.
FANOUT = 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    inner = F.btrim(line, F.lit(WHITE))
    return F.when(F.octet_length(inner) == F.length(inner), F.lower(inner)).otherwise(F.translate(inner, UPPER, LOWER))


def long_lines(docs: DataFrame, chars: int = LEAST_CHARS) -> DataFrame:
    """doc_id, doc (a hash of the text), pos and key (h1, h2) of each line whose
    key has ``chars`` code points or more."""
    text = text_or_empty()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("doc"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keyed = rows.filter(F.length("line") >= chars).select("doc_id", "doc", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= chars)
    return keyed.select("doc_id", "doc", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class Runs:
    """Sorted runs (h1, h2, last) by level in a shared folder. A key is in one run
    at most."""

    def __init__(self, spark: SparkSession, base: str, fanout: int = FANOUT):
        self.spark, self.base, self.fanout = spark, base, fanout
        self.levels: list[list[str]] = [[]]
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        path = f"{self.base}/level-{level}/run-{self.made}"
        self.made += 1
        rows.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2").write.parquet(path)
        self.levels[level].append(path)

    def each(self) -> list[DataFrame]:
        return [self.spark.read.parquet(path) for level in self.levels for path in level]

    def add(self, batch: DataFrame) -> None:
        """Takes in the keys of a batch (h1, h2, doc_id) that no run has, each with
        the largest doc_id that holds it (null only where no other does)."""
        path = f"{self.base}/batch-{self.made}"  # stored: the optimizer would else join its lines, not its keys
        own = stored(batch.groupBy("h1", "h2").agg(F.max("doc_id").alias("last")), path)
        for run in self.each():
            own = own.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(own, 0)
        remove(self.spark, path)
        self.compact()

    def compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(reduce(DataFrame.union, (self.spark.read.parquet(p) for p in old)), level + 1)
                for path in old:
                    remove(self.spark, path)

    def rows(self) -> DataFrame:
        return reduce(DataFrame.union, self.each())


def batch_of(bounds: list[int]) -> Column:
    """0 for the largest ids, one more below each bound; null ids come last."""
    return reduce(lambda n, b: n + F.when(F.col("doc_id") < b, 1).otherwise(0), bounds, F.when(F.col("doc_id").isNull(), len(bounds)).otherwise(0))


def dropped(docs: DataFrame, base: str, chars: int = LEAST_CHARS, least: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, doc and the positions of the lines that go, for each document that
    loses any. Stored below ``base``."""
    spark = docs.sparkSession
    lines = stored(long_lines(docs, chars), f"{base}/lines")
    often = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("h1", "h2")
    often = stored(often, f"{base}/often")
    bounds = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    lines.join(often, ["h1", "h2"], "left_semi").withColumn("batch", batch_of(sorted(set(bounds)))).write.partitionBy("batch").parquet(f"{base}/shared")
    shared = spark.read.schema("h1 long, h2 long, doc_id long, doc long, pos int, batch int").parquet(f"{base}/shared")
    remove(spark, f"{base}/lines")
    runs = Runs(spark, f"{base}/runs")
    for k in range(len(set(bounds)) + 1):
        runs.add(shared.filter(F.col("batch") == k).select("h1", "h2", "doc_id"))
    goes = shared.join(runs.rows(), ["h1", "h2"]).filter(~F.col("doc_id").eqNullSafe(F.col("last")))
    out = stored(goes.groupBy("doc_id", "doc").agg(F.collect_set("pos").alias("gone")), f"{base}/dropped")
    for name in ("shared", "runs", "often"):
        remove(spark, f"{base}/{name}")
    return out


KEPT = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for text, gone in zip(b.column("text").to_pylist(), b.column("gone").to_pylist(), strict=True):
            if gone:
                lines = text.split("\n")
                stays = np.ones(len(lines), bool)
                stays[gone] = False
                rows.append(("\n".join(lines[i] for i in np.flatnonzero(stays).tolist()), len(lines), len(gone)))
            else:
                rows.append((text, text.count("\n") + 1, 0))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else ((), (), ()), list(KEPT)[1:], strict=True))], schema=KEPT)


def dedup_lines(docs: DataFrame, chars: int = LEAST_CHARS, least: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """doc_id, text (what stays), n_lines (before) and n_dropped: a row for each.

    A null text is one empty line. Rows of one doc_id are one document, and so are
    rows without; these are below every id. Lines of a key repeated in the largest
    document all stay. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    gone = dropped(docs, f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}", chars, least, batches).toDF("_id", "_doc", "gone")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    joined = d.join(gone, (F.xxhash64("text") == F.col("_doc")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "text", "gone").mapInArrow(_kept, "doc_id long, text string, n_lines long, n_dropped long")


def op12_line_dedup(spark, sf_dir):
    kept = dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = rf"""
WITH line AS (SELECT doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), '{UPPER}', '{LOWER}') AS k FROM (
  SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS l FROM documents))),
often AS (SELECT k, max(doc_id) AS last FROM line WHERE length(k) >= {LEAST_CHARS} GROUP BY k HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
marked AS (SELECT l.*, o.k IS NOT NULL AND l.doc_id <> o.last AS gone FROM line l LEFT JOIN often o ON o.k = l.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256 FROM marked GROUP BY doc_id
"""
