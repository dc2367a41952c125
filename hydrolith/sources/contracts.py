"""Tables of volumes, grids and forecasts: their columns, and what holds in them.

A contract names the columns with their types, the key, the columns that the
files are partitioned by, and rules as SQL conditions that every row meets.
``violations`` counts what breaks them in one pass and one aggregate on the key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrolith.sources.sinks import publish


@dataclass(frozen=True)
class Contract:
    columns: dict[str, str]
    key: tuple[str, ...]
    parts: tuple[str, ...] = ()
    rules: dict[str, str] = field(default_factory=dict)


_MISSING = "valid = (value IS NOT NULL)"
_GATE = {"scan_id": "string", "radar": "string", "sweep": "int", "ray": "int", "gate": "int", "moment": "string", "value": "double", "valid": "boolean"}
_CELL = {"analysis": "bigint", "y": "bigint", "x": "bigint", "value": "double", "valid": "boolean"}

#: What the stores hold. Attributes of a volume or grid are a table of their own.
CONTRACTS = {
    "polar_gate": Contract(_GATE, ("scan_id", "sweep", "ray", "gate", "moment"), ("radar",), {"missing_is_null": _MISSING}),
    "qc_gate": Contract(
        {**_GATE, "quality": "double", "flags": "bigint"}, ("scan_id", "sweep", "ray", "gate", "moment"), ("radar",),
        {"missing_is_null": _MISSING, "quality_in_range": "quality BETWEEN 0 AND 1", "no_quality_of_missing": "valid OR quality IS NULL", "flags_not_negative": "flags >= 0"},
    ),
    "grid_cell": Contract({**_CELL, "source": "int", "quality": "double", "flags": "bigint"}, ("analysis", "source", "y", "x"), ("analysis",), {"missing_is_null": _MISSING, "quality_in_range": "quality BETWEEN 0 AND 1"}),
    "mosaic_cell": Contract({**_CELL, "source": "int", "contributors": "int"}, ("analysis", "y", "x"), ("analysis",), {"missing_is_null": _MISSING, "contributed": "contributors > 0 OR NOT valid"}),
    "analysis_cell": Contract(_CELL, ("analysis", "y", "x"), ("analysis",), {"missing_is_null": _MISSING, "not_negative": "value >= 0"}),
    "forecast_cell": Contract(
        {"run": "bigint", "member": "int", "lead_min": "int", "y": "bigint", "x": "bigint", "value": "double", "valid": "boolean", "confidence": "double"},
        ("run", "member", "lead_min", "y", "x"), ("run", "lead_min"),
        {"missing_is_null": _MISSING, "not_negative": "value >= 0", "confidence_in_range": "confidence BETWEEN 0 AND 1", "on_the_step": "lead_min % 6 = 0"},
    ),
}


def missing_columns(df: DataFrame, contract: Contract) -> list[str]:
    """Columns of the contract that a table lacks or has with another type."""
    have = dict(df.dtypes)
    return [c for c, t in contract.columns.items() if have.get(c) != t]


def violations(df: DataFrame, contract: Contract) -> DataFrame:
    """rule, rows: how many rows break each rule (a rule that is null for a row
    holds), have a null in the key, or repeat a key. Rows are grouped by key
    once, so a key that repeats is counted in parts before the shuffle."""
    null_key = F.lit(False)
    for c in contract.key:
        null_key = null_key | F.col(c).isNull()
    broken = {name: F.count_if(~F.coalesce(F.expr(rule), F.lit(True))) for name, rule in contract.rules.items()}
    per_key = df.groupBy(*contract.key).agg(F.count("*").alias("_n"), *[n.alias(f"_{name}") for name, n in broken.items()])
    total = per_key.agg(
        F.sum(F.when(null_key, F.col("_n")).otherwise(0)).alias("key_is_not_null"), F.sum(F.when(~null_key, F.col("_n") - 1).otherwise(0)).alias("key_is_unique"), *[F.sum(f"_{name}").alias(name) for name in broken]
    )
    names = ["key_is_not_null", "key_is_unique", *broken]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(F.col(n), F.lit(0)).alias("rows")) for n in names]))
    return total.select(each.alias("x")).select("x.rule", "x.rows")


def store(df: DataFrame, path: str, contract: Contract) -> None:
    """Publishes a table that keeps its contract; raises for one that does not."""
    if lacking := missing_columns(df, contract):
        raise ValueError(f"columns missing or of another type: {', '.join(lacking)}")
    own = df.select(*contract.columns)
    if broken := {r["rule"]: r["rows"] for r in violations(own, contract).collect() if r["rows"]}:
        raise ValueError(f"broken rules: {broken}")
    publish(own, path, list(contract.parts))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """file (below the folder), bytes and sha256 of every data file of a bundle."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    name = F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def read_verified(spark: SparkSession, path: str, expected: DataFrame, columns: list[str], where: str = "true") -> DataFrame:
    """The columns and rows of a bundle whose files are those of ``expected``
    (file, sha256); raises if one differs, lacks or is new."""
    now = file_digests(spark, path).select("file", "sha256")
    known = expected.select("file", "sha256")
    odd = now.exceptAll(known).union(known.exceptAll(now)).limit(1).collect()
    if odd:
        raise ValueError(f"not the file that was published: {odd[0]['file']}")
    return spark.read.parquet(path).filter(where).select(*columns)
