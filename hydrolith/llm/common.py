"""Pieces that the text operators share: words, row hashes and lineage cuts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the six ASCII white-space characters that separate words.
WHITE = " \t\n\x0b\x0c\r"
#: The same set as a Java regular expression.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column = "text") -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text as array<string>; a null or blank text has none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def let(value: Column, body) -> Column:
    """``body(value)`` with value computed once: inside a lambda an expression
    would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def row_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines of the cluster see, as its settings name it.
    Where none is named: a local one if driver and executors are one process,
    else an error, as a folder of one machine would lose data."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named or current.isDefined():
        return named or current.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return tempfile.mkdtemp(prefix="hydrolith-")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of ours in the shared store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def checkpoint_dir(spark: SparkSession) -> None:
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def cut(df: DataFrame) -> DataFrame:
    """Materialises a frame in the shared checkpoint folder, so that neither a
    retry nor a second consumer computes it again."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts can be long: keep Arrow batches to this many rows at most. The setting
    is read when a plan runs, so it stays; a smaller one of the caller's holds."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def stored(df: DataFrame, path: str) -> DataFrame:
    """Writes a frame to a folder of the shared store and reads it back: its
    size is then known to whatever joins it."""
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
