"""Best-fit packing of documents into sequences by bin completion.

A sequence holds whole pieces, so only the lengths matter, and a length is at
most the capacity: the whole corpus is described by one count for each length
(4096 numbers). The search runs on these counts. It takes the largest piece
left, enumerates the undominated fillings of the room beside it, the fullest
first, and prunes by waste against the best packing known, which is best-fit
decreasing's at first. The plan gives runs of
ranks within a length to runs of sequences; every piece finds its place by its
own rank, wherever it is stored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hydrolith.llm.batches import give_back
from hydrolith.llm.common import cut, small_batches, table
from hydrolith.llm.tokens import VOCABULARY, word_ids

CAPACITY = 4096
#: Pieces of a length that are ranked together, about, and the most parts of one.
PART_PIECES, MOST_PARTS = 200_000, 1 << 20
#: Nodes and choices of lengths that the search takes at most before it settles
#: for its best (one to five seconds).
STEPS = 1_000_000
#: Choices for one room after which the reachable sums are worth a table.
REACH_AFTER = 64
#: Depths from one waste bound to the next; waste alone is judged at each.
BOUND_EVERY = 16
#: Share of the pieces that are left when best fit gives the next incumbent.
INCUMBENT_EVERY = 0.9

PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PLACED = pa.schema([*PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])

#: (length, first rank, pieces in a sequence, pieces in all, first sequence, offset)
Run = tuple[int, int, int, int, int, int]


def waste_bound(n: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, from counts by length: the total, and
    pieces that exclude each other (for each k up to a half: those over the rest
    beside k, those over a half, and what of the small ones exceeds their rooms)."""
    half = capacity // 2
    cn = np.cumsum(n)
    cs = np.cumsum(n * np.arange(capacity + 1))
    least = -(-int(cs[capacity]) // capacity)
    k = np.arange(half + 1)
    mid_n, mid_s = cn[capacity - k] - cn[half], cs[capacity - k] - cs[half]
    below = np.concatenate(([0], cs[:half]))
    over = (cs[half] - below) - (mid_n * capacity - mid_s)
    return max(least, int((cn[capacity] - cn[half] + np.maximum(0, -(-over // capacity))).max()))


def best_fit(counts: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """Best-fit decreasing on counts; sequences of equal room are one interval."""
    rooms: list[int] = []
    open_: dict[int, list[tuple[int, int]]] = {}
    runs: list[Run] = []
    used = 0

    def put(room: int, interval: tuple[int, int]) -> None:
        if room and interval[1] > interval[0]:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append(interval)

    for s in sorted(counts, reverse=True):
        left, rank = counts[s], 0
        while left:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                lo, hi = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, lo = capacity, used
                hi = used + -(-left // (capacity // s))
                used = hi
            k = room // s
            full = min(hi - lo, left // k)
            if full:
                runs.append((s, rank, k, k * full, lo, capacity - room))
                put(room - k * s, (lo, lo + full))
                rank, left, lo = rank + k * full, left - k * full, lo + full
            if lo < hi and left and left < k:
                runs.append((s, rank, left, left, lo, capacity - room))
                put(room - left * s, (lo, lo + 1))
                rank, left, lo = rank + left, 0, lo + 1
            put(room, (lo, hi))
    return runs, used


def bits(present: np.ndarray) -> int:
    """A number with a bit for each length that is present."""
    return int.from_bytes(np.packbits(present, bitorder="little").tobytes(), "little")


def smeared(x: int, low: int, high: int) -> int:
    """The union of ``x`` shifted down by low, low + 1, ..., high."""
    if high < low:
        return 0
    x >>= low
    width, want = 1, high - low + 1
    while width < want:
        step = min(width, want - width)
        x |= x >> step
        width += step
    return x


class Budget:
    """Steps that the search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self) -> None:
        self.left -= 1
        if self.left < 0:
            raise StopSearch


class StopSearch(Exception):
    """The steps are used up."""


def fillings(n: np.ndarray, room: int, waste: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room`` that leave ``waste`` at most, one by
    one, the fullest first and of these the fewest pieces first.

    A filling is dominated if a length left out fits in place of a group of its
    pieces (of one smaller piece, of several whose sum is no larger, or of none)
    within the room it leaves: what a packing does with the longer one it can
    do with the group. Lengths go in from the longest; a choice after which
    every filling would be dominated is cut off by one mask of bits. ``n`` is not
    copied: whoever asks for the next filling has put it back as it was.
    """
    count = n = n[: room + 1]
    have = bits(n > 0)
    least = (have & -have).bit_length() - 1 if have else room + 1
    longest = have.bit_length() - 1
    below: list[int] = []
    lengths: list[int] = []
    tried = 0

    def sums() -> None:
        """below[i]: the sums that the i shortest lengths reach."""
        reach, full = 1, (1 << (room + 1)) - 1
        below.append(reach)
        for s in np.flatnonzero(n).tolist():
            lengths.append(s)
            k, most = 1, min(int(count[s]), room // s)
            while most > 0:
                k = min(k, most)
                reach |= (reach << (k * s)) & full
                most, k = most - k, 2 * k
            below.append(reach)

    def down(left: int, top: int, made: tuple[int, ...], groups: frozenset[int], spare: int, free: int, pieces: int) -> Iterator[tuple[int, ...]]:
        """Fillings of ``left`` by exactly ``pieces`` lengths up to ``top``;
        ``groups`` are the sums of the groups among ``made`` that matter."""
        nonlocal tried
        tried += 1
        budget.spend()
        if tried > REACH_AFTER and not lengths:
            sums()
        bad, near = smeared(free, 1, spare), smeared(free, 0, spare)
        for g in groups:
            bad |= near >> g
        cand = have & ~bad & ((1 << (min(top, left) + 1)) - 1)
        if pieces == 2:  # both halves of a pair at once
            cand &= flipped >> (room - left)
        while cand:
            s = cand.bit_length() - 1
            cand ^= 1 << s
            budget.spend()
            if s * pieces < left:
                return
            rest, own = left - s, made.count(s)
            if count[s] <= own or rest < least * (pieces - 1) or lengths and not below[bisect_left(lengths, s) + 1] >> rest & 1:
                continue
            more = frozenset(g for g in {*groups, s, *(g + s for g in groups)} if g + least <= longest)
            now = free & ~(1 << s) if count[s] == own + 1 else free
            if pieces > 2:
                yield from down(rest, s, (*made, s), more, spare, now, pieces - 1)
            elif count[rest] > made.count(rest) + (rest == s):
                end = now & ~(1 << rest) if count[rest] == made.count(rest) + 1 + (rest == s) else now
                swap, group = smeared(now, 1, spare), smeared(now, 0, spare)
                if not (end & small or swap >> rest & 1 or any(group >> (g + rest) & 1 for g in more)):
                    yield (*made, s, rest)

    #: Bit room - s for each length s, to meet pairs.
    flipped = bits(n[::-1] > 0)
    for spare in range(max(0, room - int((n * np.arange(len(n))).sum())), min(waste, room) + 1):
        want, small = room - spare, (2 << spare) - 1
        budget.spend()
        if not want:
            if not have:
                yield ()
            return
        if count[want]:
            if not (smeared(have, 1, spare) >> want & 1 or (have & ~(1 << want) if count[want] == 1 else have) & small):
                yield (want,)
            if not spare:
                return  # an exact piece stands for every other filling
        for pieces in range(2, want // least + 1):
            if pieces > 2 and lengths and not below[-1] >> want & 1:
                break
            for x in down(want, want, (), frozenset(), spare, have, pieces):
                below.clear()  # a node that waits keeps no table
                lengths.clear()
                tried = 0
                yield x


def complete(counts: dict[int, int], capacity: int = CAPACITY, steps: int = STEPS) -> tuple[list[Run], int, bool]:
    """The plan, its number of sequences and whether none can have fewer.

    Depth first. A node is the counts that are left. Its largest length gets an
    undominated filling, first as often as the counts allow, later once (once
    alone would reach every packing; often makes the way short). A node is cut
    off if its waste or the waste bound of its rest cannot beat the incumbent, or
    if it was met before with no more sequences. Incumbents are best-fit
    decreasing's: at the root, and wherever a tenth of the pieces has gone since
    the last on the way. Ends when the incumbent meets the bound, when no node is
    left (both prove it least), or after ``steps`` nodes and choices of lengths.
    Deterministic.
    """
    counts = {int(s): int(k) for s, k in counts.items() if k > 0}
    if not counts:
        return [], 0, True
    if max(counts) > capacity or min(counts) < 1:
        raise ValueError("a length is outside [1, capacity]")
    n = np.zeros(capacity + 1, np.int64)
    n[list(counts)] = list(counts.values())
    total = int((n * np.arange(capacity + 1)).sum())
    least = waste_bound(n, capacity)
    runs, used = best_fit(counts, capacity)
    budget, met = Budget(steps), {}

    left = n  # one array of counts: a step takes from it and is put back

    def branches(waste: int) -> Iterator[tuple[tuple[int, ...], int]]:
        big = int(np.flatnonzero(left)[-1])
        found = fillings(left, capacity - big, (used - 1) * capacity - total - waste, budget)
        once = []
        while True:
            left[big] -= 1
            x = next(found, None)
            left[big] += 1
            if x is None:
                break
            whole = (big, *x)
            times = min(int(left[s]) // whole.count(s) for s in set(whole))
            yield whole, times
            if times > 1:
                once.append(whole)
        for whole in once:
            yield whole, 1

    def put_back(x: tuple[int, ...], times: int) -> None:
        for s in x:
            left[s] += times

    #: A frame: sequences and waste so far, pieces at the last incumbent, branches, the path to it.
    stack = [(0, 0, int(n.sum()), branches(0), None)]
    try:
        while stack and used > least:
            made, waste, last, todo, path = stack[-1]
            step = next(todo, None)
            if step is None:
                stack.pop()
                if path:
                    put_back(*path[1:])
                continue
            budget.spend()
            x, times = step
            made, waste, path = made + times, waste + times * (capacity - sum(x)), (path, x, times)
            if waste > (used - 1) * capacity - total:
                continue
            put_back(x, -times)
            if 2 * x[0] > capacity and len(stack) % BOUND_EVERY == 0 and made + waste_bound(left, capacity) >= used:
                put_back(x, times)
                continue
            key = xxhash.xxh3_128_digest(left.tobytes())
            if met.get(key, made + 1) <= made:
                put_back(x, times)
                continue
            met[key] = made
            pieces_left = int(left.sum())
            if pieces_left <= INCUMBENT_EVERY * last:
                last = pieces_left
                tail, more = best_fit({int(s): int(left[s]) for s in np.flatnonzero(left)}, capacity)
                if made + more < used:
                    used, runs = made + more, _joined(path, tail, made)
            if pieces_left:
                stack.append((made, waste, last, branches(waste), path))
            else:
                put_back(x, times)
    except StopSearch:
        return runs, used, False
    return runs, used, True


def _joined(path: tuple | None, tail: list[Run], made: int) -> list[Run]:
    """Runs of the fillings on a path, then those of a packing of the rest."""
    steps = []
    while path:
        path, x, times = path
        steps.append((x, times))
    ranks: dict[int, int] = {}
    runs, first = [], 0
    for x, times in reversed(steps):
        offset = 0
        for s in sorted(set(x), reverse=True):
            k = x.count(s)
            runs.append((s, ranks.get(s, 0), k, k * times, first, offset))
            ranks[s] = ranks.get(s, 0) + k * times
            offset += k * s
        first += times
    return runs + [(s, rank + ranks.get(s, 0), k, n, lo + made, off) for s, rank, k, n, lo, off in tail]


def _pieces(batches: Iterator[pa.RecordBatch], capacity: int, vocabulary: str) -> Iterator[pa.RecordBatch]:
    ids_of = word_ids(vocabulary)
    for b in batches:
        rows = []
        for doc, ids in zip(b.column("doc_id").to_pylist(), ids_of(b.column("text")), strict=True):
            for n, at in enumerate(range(0, len(ids), capacity)):
                part = ids[at : at + capacity]
                rows.append((doc, n, at, len(part), zlib.crc32(part.astype("<u4").tobytes())))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECE, strict=True)], schema=PIECE)
    give_back(done=True)


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; a null text has the end id only."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _pieces(it, capacity, vocabulary), "doc_id long, piece int, start long, length long, ids_crc32 long")


def places(runs: list[Run]):
    """A function of lengths and ranks to (sequence, offset)."""
    by: dict[int, np.ndarray] = {}
    for r in sorted(runs):
        by.setdefault(r[0], []).append(r)
    by = {s: np.array(v, np.int64) for s, v in by.items()}

    def find(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for s in np.unique(length):
            own = np.flatnonzero(length == s)
            r = by[int(s)]
            x = r[np.searchsorted(r[:, 1], rank[own], side="right") - 1]
            d = rank[own] - x[:, 1]
            seq[own], off[own] = x[:, 4] + d // x[:, 2], x[:, 5] + d % x[:, 2] * s
        return seq, off

    return find


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (a stored frame: it is
    read four times). Repeated rows are pieces of their own."""
    # One row for each length: ``capacity`` rows at most.
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    most = max(counts.values(), default=0)
    p = parts.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(min(MOST_PARTS, max(256, -(-most // PART_PIECES))))))
    counted = p.groupBy("length", "_b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    runs, _, _ = complete(counts, capacity)
    own = Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "start", "ids_crc32")
    # Counts of a few parts are hashed: a task then sorts once, for the ranks.
    ranked = p.join(counted.drop("n").hint("shuffle_hash"), ["length", "_b"]).withColumn("_rank", F.row_number().over(own) - 1 + F.col("_before"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = places(runs)
        for b in batches:
            found = find(b.column("length").to_numpy(), b.column("_rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in PIECE), *map(pa.array, found)], schema=PLACED)

    return ranked.select(*PIECE.names, F.col("_rank").cast("long")).mapInArrow(assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs texts into as few sequences as the search finds.

    Null and empty texts are one id long. Repeated rows and ids are packed each
    on its own; a null id stays null. Longer documents alone are cut. An empty
    table gives no rows. Other columns are ignored.
    """
    return packed(cut(pieces(docs, capacity, vocabulary)), capacity)


def op1_best_fit_packing(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"))
