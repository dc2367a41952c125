"""Streams of scans: cycles, duplicates, the late-data waterline, states.

The batch forms of these are in the operators; here they run on unbounded
input, with state that watermarks and timers bound.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hydrolith.profiles import Waterline


def legal_move(before: Column, now: Column, moves: dict[str, list[str]], terminal: list[str], always: list[str]) -> Column:
    """Whether a state may follow another: none, the same, an error from any
    state that is not terminal, or a listed one."""
    listed = reduce(lambda a, b: a | b, [(before == k) & now.isin(v) for k, v in moves.items()], F.lit(False))
    return before.isNull() | (before == now) | (~before.isin(terminal) & (now.isin(always) | listed))


def scan_stream(spark, path: str, schema, files_a_batch: int = 100, most_age: str = "7d") -> DataFrame:
    """Arrivals in a folder; files are taken once and old ones are left out.
    The checkpoint of the query holds which files were seen."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("maxFileAge", most_age).parquet(path)


def first_seen(events: DataFrame, key: str, time: str, within: str = "10 minutes") -> DataFrame:
    """Each id once, however often it is delivered within the window."""
    return events.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def cycles(scans: DataFrame, time: str, key: str, step_s: int = 360, most_s: int = 150, late: str = "10 minutes") -> DataFrame:
    """Scans of each cycle, closed when the watermark has passed it.

    A cycle takes the times that round to it: a window that begins half a step
    before it. Its sources are counted exactly; a network has few."""
    half = step_s // 2
    s = scans.withWatermark(time, late)
    w = F.window(time, f"{step_s} seconds", startTime=f"{half} seconds")
    offset = F.unix_timestamp(time) - F.unix_timestamp(w["start"]) - half
    return s.withColumn("_d", F.abs(offset)).filter(F.col("_d") <= most_s).groupBy(w.alias("w")).agg(F.count("*").alias("scans"), F.size(F.collect_set(key)).cast("long").alias("sources")).select(
        F.timestamp_seconds(F.unix_timestamp("w.start") + half).alias("cycle"), "scans", "sources"
    )


STATE = "sources array<string>, fired boolean"
FIRED = "cycle timestamp, sources int, reason string"


def waterline_stream(arrivals: DataFrame, p: Waterline = Waterline(), keep_s: float = 86_400.0) -> DataFrame:
    """Fires each cycle once: when all sources are there and the earliest delay
    is over, or when the longest wait is. ``arrivals`` has cycle and arrived
    (timestamps) and source.

    The state of a cycle is the set of its sources (as many as the network has)
    until it fires, and then a mark that it has; it goes when the cycle is
    ``keep_s`` old. What arrives for a cycle that is older is left out, so a cycle
    cannot fire again however late its sources are, and one that waits for all of
    them does not stay for ever. The timer is processing time.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (cycle,) = key
        sources, fired = (set(state.get[0]), state.get[1]) if state.exists else (set(), False)
        now = state.getCurrentProcessingTimeMs() / 1000
        if not state.hasTimedOut:
            for f in frames:
                sources |= set(f["source"].dropna())
        age = now - cycle.timestamp()
        if age >= keep_s:
            if state.exists:
                state.remove()
            return
        complete = len(sources) >= p.expected
        reason = "all_radars_arrived" if complete and age >= p.earliest_s else "maximum_wait_elapsed" if not p.require_all and sources and age >= p.most_s else None
        if reason and not fired:
            fired = True
            yield pd.DataFrame({"cycle": [cycle], "sources": [len(sources)], "reason": [reason]})
        state.update(([] if fired else sorted(sources), fired))
        # The next moment at which something can happen.
        later = [t for t in (p.earliest_s if complete else None, None if p.require_all else p.most_s) if t is not None and t > age and not fired]
        state.setTimeoutDuration(max(1000, int((min([*later, keep_s]) - age) * 1000)))

    return arrivals.groupBy("cycle").applyInPandasWithState(run, FIRED, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def merge_once(batch: DataFrame, path: str, key: str, part: str | None = None) -> None:
    """For ``foreachBatch``: appends the rows whose id the table does not have
    yet, so a batch that is delivered again changes nothing.

    With ``part`` (such as the day of the event, which an id always has the same)
    the table is partitioned by it and only the batch's parts are read again: as
    many values as the batch spans."""
    spark = batch.sparkSession
    new = batch.dropDuplicates([key])
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(path)
        if part:
            known = known.filter(F.col(part).isin([r[0] for r in new.select(part).distinct().collect()]))
        new = new.join(known.select(key), key, "left_anti")
    w = new.write.mode("append")
    (w.partitionBy(part) if part else w).parquet(path)
