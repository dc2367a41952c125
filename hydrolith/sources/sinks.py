"""Sinks: published bundles, metrics text, point index, palettes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.functions.basic import bucket


def exposition(spark: SparkSession, name: str, kind: str, rows: DataFrame, labels: list[str]) -> DataFrame:
    """Lines of the text format of metrics: a type line and one for each row,
    whose labels are columns and whose value is ``value``."""
    pairs = [F.concat(F.lit(f'{c}="'), F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r'(["\\])', r"\\$1"), F.lit('"')) for c in labels]
    lines = rows.select(F.concat(F.lit(name + "{"), F.concat_ws(",", *pairs), F.lit("} "), F.col("value").cast("string")).alias("line"))
    return lines.unionByName(spark.range(1).select(F.lit(f"# TYPE {name} {kind}").alias("line")))


def publish(df: DataFrame, path: str, keys: list[str] | None = None, rows_a_file: int = 1_000_000) -> None:
    """Writes a bundle once: the committer's marker is its completion, and a
    path that has one is left as it is, so a replay changes nothing."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return
    w = df.write.mode("overwrite").option("maxRecordsPerFile", rows_a_file)
    (w.partitionBy(*keys) if keys else w).parquet(path)


def manifest(df: DataFrame, keys: list[str], content: list[str]) -> DataFrame:
    """For each part of a bundle: rows and an order-free digest of its content
    (the sum of row hashes), to compare bundles by."""
    h = F.xxhash64(*content).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("digest"))


#: The point index stores confidence as 0 to 254, and 255 for missing.
STEPS, MISSING = 254, 255


def point_records(cells: DataFrame) -> DataFrame:
    """The point index: one row for each cell, with rates and quantised
    confidences by lead, sorted so that a point or a box prunes row groups."""
    ok = F.col("valid") & F.col("rate").isNotNull()
    code = F.when(ok, F.bround(F.col("confidence") * F.lit(float(STEPS)))).otherwise(F.lit(float(MISSING))).cast("int")
    each = cells.select("product", "y", "x", F.struct("lead", F.when(ok, F.col("rate").cast("float")).alias("rate"), code.alias("code")).alias("r"))
    return each.groupBy("product", "y", "x").agg(F.array_sort(F.collect_list("r")).alias("leads"))


def write_point_index(cells: DataFrame, path: str) -> None:
    r = point_records(cells)
    r.repartitionByRange("product", "y", "x").sortWithinPartitions("product", "y", "x").write.mode("overwrite").parquet(path)


def at_point(index: DataFrame, product: str, west: float, south: float, step: float, longitude: float, latitude: float) -> DataFrame:
    """Rates by lead at the cell nearest to a point."""
    x, y = int((longitude - west) / step + 0.5), int((latitude - south) / step + 0.5)
    r = index.filter((F.col("product") == product) & (F.col("y") == y) & (F.col("x") == x)).select(F.explode("leads").alias("r"))
    return r.select("r.lead", "r.rate", F.when(F.col("r.code") != MISSING, F.col("r.code") / F.lit(float(STEPS))).alias("confidence"))


def palette(value: Column, stops: list[float], colours: list[str], least: float) -> Column:
    """Colour of a value by its stop; transparent under ``least`` or missing."""
    at = bucket(value, stops)
    clear = "#00000000"
    return F.when(value.isNull() | (value < least) | (at < 0), F.lit(clear)).otherwise(F.element_at(F.lit(colours), at + 1))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "nan").csv(path)
