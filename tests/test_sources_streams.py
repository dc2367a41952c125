"""Volumes made by hand, arrivals, sinks and streams."""

import bz2
import datetime as dt
import struct

import pytest
from pyspark.sql import functions as F

from hydrolith.profiles import Waterline
from hydrolith.sources import polar, sinks, tables
from hydrolith.streaming import cycles


def volume(kind: int = 1, rays: int = 3) -> bytes:
    lay = polar.LAYOUTS[kind]
    site = bytearray(lay.site)
    polar.SITE_FIELDS.pack_into(site, 0, b"Z9001", b"name", 25.5, 119.5)
    task = bytearray(lay.task)
    task[:4] = b"VCP1"
    struct.pack_into("<i", task, lay.cuts_at, 2)
    beams = b""
    if lay.beams_at is not None:
        struct.pack_into("<i", task, lay.beams_at, 1)
        beams = bytes(lay.beam)
    out = polar.GENERIC.pack(polar.MAGIC, 2, 0, kind, 0, bytes(16)) + site + task + beams
    for c in range(2):
        cut = bytearray(lay.cut)
        struct.pack_into("<f", cut, lay.elevation_at, 0.5 + c)
        struct.pack_into(lay.resolution, cut, lay.resolution_at, 250, 125)
        struct.pack_into("<i", cut, lay.start_at, 100)
        out += cut
    for c in (1, 2):
        for r in range(rays):
            body = polar.MOMENT.pack(2, 2, 66, 1, 0, 3, bytes(12)) + bytes([0, 66, 106]) + polar.MOMENT.pack(3, 10, 100, 2, 0, 4, bytes(12)) + struct.pack("<2H", 4, 1100)
            head = bytearray(lay.ray)
            lay.ray_fields.pack_into(head, 0, 0, 0, 0, r, c, 361.0 + r, 0.5, 1_700_000_000 + r, 5, len(body), 2)
            out += head + body
    return bytes(out)


@pytest.mark.parametrize("kind", [1, 16])
def test_volume(spark, tmp_path, kind):
    (tmp_path / "a.bin").write_bytes(volume(kind))
    (tmp_path / "b.bin.bz2").write_bytes(bz2.compress(volume(kind, 2)))
    rows = polar.read_volumes(spark, str(tmp_path))
    assert rows.count() == 2 * 2 * 3 + 2 * 2 * 2
    v = rows.withColumns({"v": polar.physical(F.col("codes"), F.col("scale"), F.col("offset")), "r": polar.gate_centres(F.col("codes"), F.col("start_m"), F.col("resolution_m"))})
    ref = v.filter("moment = 'REF' AND sweep = 2 AND ray = 1").first()
    assert ref.v == [None, 0.0, 20.0] and ref.r == [225.0, 475.0, 725.0] and ref.azimuth == 2.0 and ref.site == "Z9001" and ref.elevation_nominal == 1.5
    vel = v.filter("moment = 'VEL'").first()
    assert vel.v == [None, 100.0] and vel.r == [162.5, 287.5]
    t = polar.volume_times(rows).orderBy("rays").collect()
    assert [x.rays for x in t] == [4, 6] and t[1].end_us - t[1].start_us == 2_000_000
    assert polar.constant_geometry(rows).count() == 0


def test_bad_volumes():
    good = volume()
    for bad in (b"", good[:100], good[:-1], b"XXXX" + good[4:]):
        with pytest.raises((polar.BadVolume, struct.error)):
            list(polar.rays(bad))


def test_arrivals(spark):
    now = F.lit("2026-01-02 00:00:00").cast("timestamp")
    at = lambda s: dt.datetime(2026, 1, 2) - dt.timedelta(seconds=s)
    files = spark.createDataFrame([("a", 1, at(100)), ("b", 2, at(100)), ("c", 3, at(5)), ("d", 4, at(999_999)), ("e", 5, at(100))], "path string, size long, modified timestamp")
    ledger = spark.createDataFrame([("a", 1, at(100), False), ("b", 1, at(100), False), ("c", 3, at(5), False), ("e", 5, at(100), True), ("gone", 1, at(50), False)], "path string, size long, modified timestamp, processed boolean")
    got = {r.path: (r.processed, r.ready) for r in tables.arrivals(files, ledger, now, 30, 86400).collect()}
    assert got == {"a": (False, True), "b": (False, False), "c": (False, False), "e": (True, False)}


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 0, 0, 6, 2.0, 0.5, True), (1, 0, 0, 12, None, 0.5, False), (1, 1, 0, 6, 0.0, 1.0, True)], "product int, y int, x int, lead int, rate double, confidence double, valid boolean")
    sinks.write_point_index(d, str(tmp_path / "index"))
    got = sinks.at_point(spark.read.parquet(str(tmp_path / "index")), 1, 118.0, 25.0, 0.01, 118.001, 25.004).orderBy("lead").collect()
    assert [(r.lead, r.rate, r.confidence) for r in got] == [(6, 2.0, 0.5), (12, None, None)]
    path = str(tmp_path / "bundle")
    sinks.publish(d, path, ["lead"])
    sinks.publish(d.limit(0), path, ["lead"])
    assert spark.read.parquet(path).count() == 3
    m = sinks.manifest(d, ["lead"], ["y", "x", "rate"]).collect()
    assert sorted(r.rows for r in m) == [1, 2]
    sinks.write_csv(d.select("lead", "rate"), str(tmp_path / "csv"))
    assert tables.read_metrics(spark, str(tmp_path / "csv"), "lead int, rate double").filter("rate IS NULL").count() == 1


def run(stream, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    q.stop()
    return stream.sparkSession.table(name)


def test_streams(spark, tmp_path):
    t0 = dt.datetime(2026, 1, 1)
    rows = [(f"e{i}", t0 + dt.timedelta(seconds=s), r) for i, (s, r) in enumerate([(0, "a"), (100, "b"), (170, "c"), (400, "a"), (350, "b"), (9000, "z")])]
    df = spark.createDataFrame(rows + rows[:2], "id string, t timestamp, radar string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = cycles.scan_stream(spark, str(tmp_path / "in"), df.schema)
    assert run(cycles.first_seen(stream, "id", "t"), "seen").count() == 6
    stream = cycles.scan_stream(spark, str(tmp_path / "in"), df.schema)
    got = {r.cycle.strftime("%H:%M"): (r.scans, r.sources) for r in run(cycles.cycles(stream, "t", "radar"), "cycles").collect()}
    assert got == {"00:00": (4, 2), "00:06": (2, 2)}


def test_waterline_stream(spark, tmp_path):
    old, new = dt.datetime.now() - dt.timedelta(hours=3), dt.datetime.now() + dt.timedelta(hours=1)
    rows = [(old, r) for r in "abcd"] + [(old + dt.timedelta(hours=1), "a"), (new, "a"), (old - dt.timedelta(days=2), "a")]
    spark.createDataFrame(rows, "cycle timestamp, source string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("cycle timestamp, source string").parquet(str(tmp_path / "in"))
    got = sorted((r.sources, r.reason) for r in run(cycles.waterline_stream(stream, Waterline()), "fired").collect())
    assert got == [(1, "maximum_wait_elapsed"), (4, "all_radars_arrived")]


def test_merge_once(spark, tmp_path):
    path = str(tmp_path / "inbox")
    a = spark.createDataFrame([("x", 1), ("y", 2), ("x", 1)], "event_id string, v int")
    cycles.merge_once(a, path, "event_id")
    cycles.merge_once(a, path, "event_id")
    assert spark.read.parquet(path).count() == 2


class FakeState:
    """What a group's state offers, for one cycle and a clock of the test's."""

    def __init__(self):
        self.value, self.now, self.hasTimedOut, self.wait = None, 0.0, False, None

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def getCurrentProcessingTimeMs(self):
        return int(self.now * 1000)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutDuration(self, ms):
        self.wait = ms / 1000


def fires(spark, monkeypatch, steps, p):
    """Drives the stream's own function: steps are (seconds after the cycle,
    sources or None for the timer)."""
    import pandas as pd
    held = {}
    kind = type(spark.range(1).groupBy("id"))
    monkeypatch.setattr(kind, "applyInPandasWithState", lambda self, f, *a: held.update(f=f))
    cycles.waterline_stream(spark.createDataFrame([], "cycle timestamp, source string"), p)
    cycle, state, out = pd.Timestamp("2026-01-01", tz="UTC"), FakeState(), []
    for at, sources in steps:
        state.now, state.hasTimedOut = cycle.timestamp() + at, sources is None
        frames = iter([] if sources is None else [pd.DataFrame({"cycle": [cycle] * len(sources), "source": list(sources)})])
        out += [(at, *f[["sources", "reason"]].iloc[0]) for f in held["f"]((cycle,), frames, state)]
    return out, state


def test_waterline_fires_once(spark, monkeypatch):
    p = Waterline()
    got, state = fires(spark, monkeypatch, [(40, "abcd"), (241, None), (300, "e"), (90_000, "f")], p)
    assert got == [(40, 4, "all_radars_arrived")] and state.value is None
    got, state = fires(spark, monkeypatch, [(60, "ab"), (180, None), (240, None), (250, "cd")], p)
    assert got == [(240, 2, "maximum_wait_elapsed")] and state.value == ([], True)
    import dataclasses

    every = dataclasses.replace(p, require_all=True)
    got, state = fires(spark, monkeypatch, [(60, "abc"), (1200, None)], every)
    assert got == [] and state.wait > 80_000
    assert fires(spark, monkeypatch, [(60, "abc"), (1200, "d")], every)[0] == [(1200, 4, "all_radars_arrived")]


def test_merge_once_by_day(spark, tmp_path):
    path = str(tmp_path / "inbox")
    rows = spark.createDataFrame([("x", 1, "d1"), ("y", 2, "d2"), ("x", 1, "d1")], "event_id string, v int, day string")
    cycles.merge_once(rows, path, "event_id", "day")
    cycles.merge_once(rows.union(spark.createDataFrame([("z", 3, "d2")], rows.schema)), path, "event_id", "day")
    assert spark.read.parquet(path).count() == 3


def test_contracts(spark, tmp_path):
    import pytest

    from hydrolith.sources import contracts

    c = contracts.CONTRACTS["analysis_cell"]
    good = spark.createDataFrame([(1, 0, 0, 2.5, True), (1, 0, 1, None, False)], "analysis long, y long, x long, value double, valid boolean")
    path = str(tmp_path / "cells")
    contracts.store(good, path, c)
    # Stored apart: a cached frame would answer for the folder as it is later.
    digests = spark.createDataFrame(contracts.file_digests(spark, path).collect())
    assert digests.count() > 0
    got = contracts.read_verified(spark, path, digests, ["x", "value"], "value IS NOT NULL").collect()
    assert [(r.x, r.value) for r in got] == [(0, 2.5)]
    with pytest.raises(ValueError, match="broken rules"):
        contracts.store(good.union(good), str(tmp_path / "twice"), c)
    with pytest.raises(ValueError, match="columns missing"):
        contracts.store(good.drop("value"), str(tmp_path / "less"), c)
    good.write.mode("append").parquet(f"{path}/analysis=2")
    with pytest.raises(ValueError, match="not the file"):
        contracts.read_verified(spark, path, digests, ["x"])
    assert {r.rule: r.rows for r in contracts.violations(good.limit(0), c).collect()} == {"key_is_not_null": 0, "key_is_unique": 0, "missing_is_null": 0, "not_negative": 0}
