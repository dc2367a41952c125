"""Signed-bit voting on 64-bit term hashes, in built-in functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One bit in each half of a long: two 32-bit counters are summed at once.
PAIR = 0x0000000100000001
HALF = 0xFFFFFFFF


def signed(bit: int) -> int:
    """2**bit as a signed long."""
    return (1 << bit) - (1 << 64) if bit == 63 else 1 << bit


def vote(rows: DataFrame, keys: list[str], terms: str, weighted: bool = False) -> DataFrame:
    """One row per key: ``fingerprint`` (a bit is 1 if over half of the weight
    of the terms has it), ``weight`` and ``copies`` (rows that had the key).

    ``terms`` is an array of hashes, or of structs (h, w) if ``weighted``.
    Votes are summed where the rows are; only one row of sums for each key and
    task is shuffled. Rows of one key must have the same terms: their votes
    then scale together and the majority is the same. A key without terms gets
    the fingerprint zero.
    """
    if weighted:
        flat = rows.select(*keys, F.posexplode_outer(terms).alias("_pos", "_t")).select(*keys, "_pos", F.col("_t.h").alias("_h"), F.col("_t.w").cast("long").alias("_w"))
    else:
        flat = rows.select(*keys, F.posexplode_outer(terms).alias("_pos", "_h")).withColumn("_w", F.when(F.col("_h").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long"))
    lane = lambda k: F.shiftrightunsigned("_h", k).bitwiseAND(F.lit(PAIR))
    sums = [F.sum(lane(k) * F.col("_w") if weighted else lane(k)).alias(f"_v{k}") for k in range(32)]
    first = F.when(F.coalesce(F.col("_pos"), F.lit(0)) == 0, F.lit(1)).otherwise(F.lit(0))
    counted = flat.groupBy(*keys).agg(F.sum(first).alias("copies"), F.coalesce(F.sum("_w"), F.lit(0)).alias("weight"), *sums)
    bits: list[Column] = []
    for k in range(32):
        both = F.coalesce(F.col(f"_v{k}"), F.lit(0))
        for bit, n in ((k, both.bitwiseAND(F.lit(HALF))), (k + 32, F.shiftrightunsigned(both, 32))):
            bits.append(F.when(n * 2 > F.col("weight"), F.lit(signed(bit))).otherwise(F.lit(0)))
    return counted.select(*keys, "copies", "weight", reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def hex16(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)
