"""Sources other than volumes: arrivals, reports, catalogues, terrain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, size and modified of files; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def arrivals(now_listing: DataFrame, ledger: DataFrame, now: Column, least_age_s: int, lookback_s: int) -> DataFrame:
    """The next ledger: path, size, modified, processed, and whether a file is
    ready. A file is ready when its size and time are those of the last look,
    it is old enough and not yet processed; files that are gone or too old
    leave the ledger."""
    age = F.unix_timestamp(now) - F.unix_timestamp("modified")
    seen = ledger.select("path", F.col("size").alias("_s"), F.col("modified").alias("_m"), F.col("processed").alias("_p"))
    j = now_listing.filter(age <= lookback_s).join(seen, "path", "left")
    same = F.coalesce((F.col("size") == F.col("_s")) & (F.col("modified") == F.col("_m")), F.lit(False))
    processed = same & F.coalesce("_p", F.lit(False))
    return j.select("path", "size", "modified", processed.alias("processed"), (same & ~processed & (age >= least_age_s)).alias("ready"))


def partitions_since(df: DataFrame, column: str, now: Column, lookback_s: int) -> DataFrame:
    """Rows of day partitions (yyyyMMdd) that do not end before the lookback;
    a filter on the partition column, so folders before it are not listed."""
    first = F.date_format(F.timestamp_seconds(F.unix_timestamp(now) - lookback_s), "yyyyMMdd")
    return df.filter(F.col(column) >= first)


#: Metric rows of a verification report; empty and "nan" are null.
METRICS = "case_id string, model string, lead_minutes int, threshold_mm_h double, window_km double, csi double, pod double, far double, fss double, mae double, rmse double, evaluation_cell_count long"


def read_metrics(spark: SparkSession, path: str, schema: str = METRICS) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("nullValue", "nan").option("mode", "FAILFAST").csv(path)


def read_reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document for each file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def catalogue(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 16, properties: dict | None = None) -> DataFrame:
    """A table of a database; with a number column it is read in parts."""
    if column and bounds:
        return spark.read.jdbc(url, table, column=column, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=properties or {})
    return spark.read.jdbc(url, table, properties=properties or {})


def listed_objects(pages: DataFrame, pattern: str) -> DataFrame:
    """Names in listings (XML or HTML text in ``body``) that match a pattern
    with one group, each with its listing."""
    found = F.regexp_extract_all(F.col("body"), F.lit(pattern), F.lit(1))
    return pages.select("listing", F.explode(F.array_distinct(found)).alias("name"))


def sampled_terrain(points: DataFrame, tiles: DataFrame, bounds: tuple[float, float, float, float], cells_a_degree: int) -> DataFrame:
    """Adds ``terrain_m``: the cell under each point (longitude, latitude).

    ``tiles`` has tile_x, tile_y (whole degrees), row, col and height. A cell
    that no tile has is sea, 0.0; a point outside the bounds is null. The join
    is an equality on tile and cell, so only cells under points meet."""
    west, south, east, north = bounds
    x, y = F.floor("longitude"), F.floor("latitude")
    inside = F.col("longitude").between(west, east) & F.col("latitude").between(south, north)
    cell = lambda c, base: F.least(F.floor((F.col(c) - base) * F.lit(cells_a_degree)), F.lit(cells_a_degree - 1)).cast("int")
    p = points.withColumns({"tile_x": x.cast("int"), "tile_y": y.cast("int"), "col": cell("longitude", x), "row": cell("latitude", y), "_in": F.coalesce(inside, F.lit(False))})
    j = p.join(tiles.select("tile_x", "tile_y", "row", "col", F.col("height").alias("_h")), ["tile_x", "tile_y", "row", "col"], "left")
    return j.withColumn("terrain_m", F.when(F.col("_in"), F.coalesce("_h", F.lit(0.0)))).select(*points.columns, "terrain_m")
