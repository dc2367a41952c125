"""Packing against exhaustive search; token rows as an exact round trip."""

import zlib
from itertools import combinations, permutations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from hydrolith.llm import packing, rows
from hydrolith.llm.tokens import WordIds, vocabulary_path

SF = "/root/testdata/sf0.001"


def least_bins(lengths: list[int], capacity: int) -> int:
    best = len(lengths)
    for order in set(permutations(lengths)):
        bins, room = 0, 0
        for n in order:
            if n > room:
                bins, room = bins + 1, capacity
            room -= n
        best = min(best, bins)
    return best


def placed(runs, counts):
    find = packing.places(runs)
    out = {}
    for s, n in counts.items():
        seq, off = find(np.full(n, s), np.arange(n))
        for q, o in zip(seq.tolist(), off.tolist(), strict=True):
            out.setdefault(q, []).append((o, s))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
def test_as_few_as_exhaustive(lengths):
    counts = {s: lengths.count(s) for s in set(lengths)}
    runs, used, least = packing.complete(counts, 20)
    assert used == least_bins(lengths, 20) and least


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_places_are_gapless(counts):
    runs, used, _ = packing.complete(counts, 64)
    bins = placed(runs, counts)
    assert len(bins) == used >= packing.waste_bound(table(counts, 64), 64)
    for parts in bins.values():
        at = 0
        for o, s in sorted(parts):
            assert o == at
            at += s
        assert at <= 64


def table(counts: dict[int, int], capacity: int) -> np.ndarray:
    n = np.zeros(capacity + 1, np.int64)
    for s, k in counts.items():
        n[s] = k
    return n


def undominated(pieces: list[int], room: int) -> set[tuple[int, ...]]:
    """By the definition: no piece left out fits for a group of those within."""
    found = set()
    for k in range(len(pieces) + 1):
        for own in combinations(range(len(pieces)), k):
            spare = room - sum(pieces[i] for i in own)
            if spare < 0:
                continue
            out = [pieces[i] for i in range(len(pieces)) if i not in own]
            groups = [[pieces[i] for i in g] for n in range(len(own) + 1) for g in combinations(own, n)]
            if not any(sum(g) <= t <= sum(g) + spare and g != [t] for g in groups for t in out):
                found.add(tuple(sorted((pieces[i] for i in own), reverse=True)))
    return found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 25), max_size=8), st.integers(0, 40))
def test_fillings_are_the_undominated(pieces, room):
    counts = {s: pieces.count(s) for s in set(pieces)}
    n = table(counts, max([*pieces, room]))
    n = np.pad(n, (0, max(0, room + 1 - len(n))))
    got = list(packing.fillings(n, room, room, packing.Budget(10**9)))
    assert len(got) == len(set(got)) and [sum(x) for x in got] == sorted((sum(x) for x in got), reverse=True)
    assert set(got) == undominated([s for s in pieces if s <= room], room)


def test_search_beats_best_fit():
    """Best fit needs a sequence more here, and on drawn lengths as well."""
    counts = {4: 1, 6: 1, 7: 2, 9: 1, 11: 2, 12: 1}
    assert packing.best_fit(counts, 23)[1] == 4 and packing.complete(counts, 23)[1:] == (3, True)
    rng = np.random.default_rng(1)
    won = 0
    for _ in range(10):
        lengths, k = np.unique(np.minimum(rng.lognormal(6.4, 1, 20_000).astype(int) + 1, 4096), return_counts=True)
        counts = dict(zip(lengths.tolist(), k.tolist(), strict=True))
        runs, used, least = packing.complete(counts)
        won += used < packing.best_fit(counts, 4096)[1]
        assert len(placed(runs, counts)) == used
    assert won


def test_search_stops_by_its_steps():
    lengths, k = np.unique(np.random.default_rng(1).integers(1000, 2001, 3000), return_counts=True)
    counts = dict(zip(lengths.tolist(), k.tolist(), strict=True))
    first = packing.complete(counts, steps=5000)
    assert not first[2] and first == packing.complete(counts, steps=5000)


def test_ids_equal_the_tokenizers(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()] + ["", " a  b ", "x\n\ny\t z w", "İstanbul ǅ ß!?"]
    got = WordIds()(texts)
    for text, ids in zip(texts, got, strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_pack_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = dict(zip([r.doc_id for r in docs.collect()], WordIds()([r.text for r in docs.collect()]), strict=True))
    got = packing.pack(docs).collect()
    bins: dict[int, list] = {}
    back: dict[int, dict] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(part.astype("<u4").tobytes()) == r.ids_crc32
        back.setdefault(r.doc_id, {})[r.piece] = (r.start, r.length)
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096
    for doc, pieces in back.items():
        at = 0
        for k in range(len(pieces)):
            assert pieces[k][0] == at and (pieces[k][1] == 4096 or k == len(pieces) - 1)
            at += pieces[k][1]
        assert at == len(ids[doc])
    counts: dict[int, int] = {}
    for r in got:
        counts[r.length] = counts.get(r.length, 0) + 1
    assert len(bins) <= packing.best_fit(counts, 4096)[1]


def test_rows_round_trip(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = dict(zip([r.doc_id for r in docs.collect()], WordIds()([r.text for r in docs.collect()]), strict=True))
    back: dict[int, dict[int, np.ndarray]] = {}
    for r in rows.token_rows(docs).collect():
        line = np.frombuffer(r.ids, "<u4")
        pos = np.frombuffer(r.positions, "<i4")
        assert len(line) == len(pos) == rows.ROW and r.segment_ends[0] == 0 and r.segment_ends[-1] == r.n_ids
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.segment_ends[:-1], r.segment_ends[1:], strict=True):
            assert pos[a:b].tolist() == list(range(b - a))
            back.setdefault(doc, {})[piece] = line[a:b]
        assert not line[r.n_ids :].any()
    for doc, parts in back.items():
        assert np.concatenate([parts[k] for k in sorted(parts)]).tolist() == ids[doc].tolist()
    assert set(back) == set(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_best_fit_decreasing(lengths):
    """The segment tree finds the row that a scan of all rows would."""
    room: list[int] = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= n
        else:
            room.append(32 - n)
    got = rows.best_fit_rows(lengths, 32)
    assert sorted(32 - sum(lengths[i] for i in r) for r in got) == sorted(room)
