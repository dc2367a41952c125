"""Token-id output: rows of a fixed length, packed best-fit decreasing.

A task packs its own rows in blocks, so nothing is shuffled and nothing grows
with the corpus. Within a block, pieces go by decreasing length to the open row
with the least room that holds them; a segment tree over room sizes finds it.
Rows with much room left at the end of a block are opened again in the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import small_batches, table
from hydrolith.llm.tokens import VOCABULARY, word_ids

ROW = 2048
PAD = 0
#: Ids that a task gathers before it packs them.
BLOCK_IDS = 2_000_000

SCHEMA = (
    "shard int, row int, n_ids int, ids binary, positions binary, segment_ends array<int>, "
    "doc_ids array<bigint>, pieces array<int>, starts array<bigint>"
)
ARROW = pa.schema([
    ("shard", pa.int32()), ("row", pa.int32()), ("n_ids", pa.int32()), ("ids", pa.binary()), ("positions", pa.binary()), ("segment_ends", pa.list_(pa.int32())),
    ("doc_ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("starts", pa.list_(pa.int64())),
])


class Rooms:
    """Open rows by room; a segment tree tells which rooms are there."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _set(self, room: int, present: bool) -> None:
        i = room + self.leaves
        self.any[i] = present
        while i > 1:
            i >>= 1
            now = self.any[2 * i] or self.any[2 * i + 1]
            if self.any[i] == now:
                break
            self.any[i] = now

    def add(self, room: int, row: int) -> None:
        own = self.rows.setdefault(room, [])
        if not own:
            self._set(room, True)
        own.append(row)

    def take(self, least: int) -> tuple[int, int] | None:
        """The row with the least room of ``least`` at least, taken out."""
        i = least + self.leaves
        if not self.any[i]:
            while i > 1 and not (i % 2 == 0 and self.any[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.any[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self._set(room, False)
        return room, row


def best_fit_rows(lengths: list[int], row: int) -> list[list[int]]:
    """Indices of ``lengths`` (each 1 to ``row``) in rows."""
    rooms, out = Rooms(row), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        room, r = rooms.take(n) or (row, len(out))
        if r == len(out):
            out.append([])
        out[r].append(i)
        if room > n:
            rooms.add(room - n, r)
    return out


def _rows(batches: Iterator[pa.RecordBatch], row: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    ids_of, shard, made = word_ids(vocabulary), TaskContext.get().partitionId(), 0
    held: list[tuple[int | None, int, int, np.ndarray]] = []
    total = 0

    def flush(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, total, made
        back, out = [], []
        for members in best_fit_rows([len(x[3]) for x in held], row):
            parts = [held[i] for i in members]
            n = sum(len(p[3]) for p in parts)
            if not final and row - n > row // 32 and len(back) < 4096:
                back += parts
                continue
            ids, positions = np.full(row, PAD, "<u4"), np.zeros(row, "<i4")
            ids[:n] = np.concatenate([p[3] for p in parts])
            positions[:n] = np.concatenate([np.arange(len(p[3])) for p in parts])
            ends = np.cumsum([len(p[3]) for p in parts])
            out.append((shard, made, n, ids.tobytes(), positions.tobytes(), [0, *ends.tolist()], [p[0] for p in parts], [p[1] for p in parts], [p[2] for p in parts]))
            made += 1
        held, total = back, sum(len(p[3]) for p in back)
        for at in range(0, len(out), 256):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[at : at + 256], strict=True), ARROW, strict=True)], schema=ARROW)

    for b in batches:
        for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of(b.column("text")), strict=True):
            for piece, at in enumerate(range(0, len(ids), row)):
                held.append((doc, piece, at, ids[at : at + row]))
            total += len(ids)
        if total >= BLOCK_IDS or len(held) >= BLOCK_IDS // 8:
            yield from flush(False)
    if held:
        yield from flush(True)


def token_rows(docs: DataFrame, row: int = ROW, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row for each packed row of ``row`` ids.

    ``ids`` and ``positions`` are little-endian 32-bit arrays of ``row`` numbers,
    padded with ``PAD`` and 0; positions begin at 0 in each segment;
    ``segment_ends`` are the cumulative lengths from 0; ``doc_ids``, ``pieces``
    and ``starts`` name the segments. Only documents longer than a row are cut,
    and their pieces hold all their ids. Null and empty texts are one end id.
    Repeated rows are packed each on its own; null ids stay null. A task packs
    its own documents, so which share a row depends on the input's partitions;
    the ids of a document do not.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _rows(it, row, vocabulary), SCHEMA)


def write_rows(docs: DataFrame, path: str, row: int = ROW, vocabulary: str = VOCABULARY) -> None:
    """Writes the rows as Parquet; each file is a matrix of ids in column ``ids``."""
    token_rows(docs, row, vocabulary).write.mode("overwrite").parquet(path)


def matrix(ids: list[bytes], row: int = ROW) -> np.ndarray:
    return np.frombuffer(b"".join(ids), "<u4").reshape(-1, row)


def op9_token_rows(spark, sf_dir):
    t = token_rows(table(spark, sf_dir, "documents"))
    return t.select("shard", "row", "n_ids", F.crc32("ids").alias("ids_crc32"), F.crc32("positions").alias("positions_crc32"), "segment_ends", "doc_ids", "pieces", "starts")


__all__ = ["best_fit_rows", "matrix", "op9_token_rows", "token_rows", "write_rows"]
