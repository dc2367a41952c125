"""SimHash and its joins against brute force."""

import hashlib
import random
import re

import numpy as np
import xxhash

from hydrolith.llm import fingerprints, neardup
from hydrolith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def majority(hashes: list[tuple[int, int]]) -> int:
    total = sum(w for _, w in hashes)
    return sum(1 << b for b in range(64) if 2 * sum(w for h, w in hashes if h >> b & 1) > total)


def chained(a: str, b: str | None) -> int:
    h = xxhash.xxh64_intdigest(a.encode(), seed=42)
    return h if b is None else xxhash.xxh64_intdigest(b.encode(), seed=h)


def weighted(text: str) -> int:
    w = WORD.findall(text.lower())
    terms = [(chained(a, b), min(16, len(a) + len(b or ""))) for a, b in zip(w, [*w[1:], None], strict=True)]
    return majority(terms)


def test_documents_and_their_edits(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    got = {r.doc_id: r for r in QUERIES["op3_document_fingerprints"](spark, SF).collect()}
    assert len(got) == len(docs)
    short = [i for i, (_, t) in enumerate(docs) if len(t) < 3000]
    for i, (k, t) in enumerate(docs):
        after = docs[(i + 1) % len(docs)][1]
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        assert got[k].n_chars == len(t) and got[k].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if i in short[:60]:
            f, g = weighted(t), weighted(edited)
            assert got[k].fingerprint == f"{f:016x}" and got[k].edited_fingerprint == f"{g:016x}"
            assert abs(got[k].near_edited - (1 - (f ^ g).bit_count() / 64)) < 1e-12


def test_block_tables_find_all(spark):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(60)]
    values = {(b ^ sum(1 << x for x in r.sample(range(64), k))) for b in base for k in range(6)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    f = spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "fingerprint long")
    got = {(p.query, p.fingerprint): p.bits for p in fingerprints.find_within(f, f, 3, 6).collect()}
    want = {(a, b): d for a in signed for b in signed if (d := ((a ^ b) & (2**64 - 1)).bit_count()) <= 3}
    assert got == want


def shingled(text: str) -> int:
    low = text.translate({c: c + 32 for c in range(65, 91)})
    w = WORD.findall(low)
    parts = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    return majority([(xxhash.xxh64_intdigest(p.encode(), seed=42), 1) for p in parts])


def test_near_dedup_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in QUERIES["op10_simhash_near_dedup"](spark, SF).collect()}
    f = {k: int(got[k].fingerprint, 16) for k in docs}
    for k in list(docs)[:80]:
        assert f[k] == shingled(docs[k])
    up = {k: k for k in docs}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    keys = sorted(docs)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (f[a] ^ f[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {k: got[k].component_id for k in keys} == {k: root(k) for k in keys}


def test_chains_and_trie(spark):
    """A chain of fingerprints two bits apart is one component."""
    r = random.Random(2)
    chain = [r.getrandbits(64)]
    for _ in range(40):
        chain.append(chain[-1] ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)))
    other = [r.getrandbits(64) for _ in range(200)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in {*chain, *other}], "fp long").repartition(5)
    from hydrolith.llm.components import components

    got = {c.node: c.root for c in components(neardup.linked(df)).collect()}
    assert len({got[signed(v)] for v in chain}) == 1
    assert not any(signed(v) in got for v in other)


def test_one_document_of_each_group(spark):
    """Null ids in different groups and one id on two texts lose no group."""
    a, b, c, d, e = (" ".join(f"{w}{i}" for i in range(40)) for w in ("ash", "birch", "cedar", "dogwood", "elm"))
    made = [(None, a), (None, b), (7, b), (9, b), (5, c), (5, d), (6, d), (None, e), (None, e), (8, a), (8, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in neardup.deduplicated(docs).collect()), key=str)
    assert got == sorted([(8, a), (7, b), (5, c), (5, d), (None, e), (8, None)], key=str)
    n = {(r.k, r.h): r for r in neardup.near_duplicates(docs).collect()}
    assert sorted(r.component for r in n.values()) == sorted([8, 8, 7, 7, 7, 5, 5, 5, neardup.NO_ID, 8])
    assert len({r.root for r in n.values()}) == 6


def test_successors_of_hot_ids(spark, monkeypatch):
    """An id that fills many ranges is parted by its hashes; the order holds."""
    monkeypatch.setattr(fingerprints, "RANGE_ROWS", 10)
    monkeypatch.setattr(fingerprints, "MIN_RANGES", 4)
    r = random.Random(4)
    pairs = {(r.choice([fingerprints.NO_ID, 7, r.randrange(1000), (1 << 63) - 1]), r.getrandbits(64) - (1 << 63)) for _ in range(600)}
    ids = spark.createDataFrame(sorted(pairs), "k long, h long").repartition(3)
    number, many = fingerprints.ranges_of(ids)
    sizes = ids.groupBy(number.alias("r")).count().collect()
    assert max(x["count"] for x in sizes) < 60 and many < 400
    order = sorted(pairs)
    got = {(x.k, x.h): (x.nk, x.nh) for x in fingerprints.successors(ids).collect()}
    assert got == {a: order[(i + 1) % len(order)] for i, a in enumerate(order)}


def test_search_counts_all_within(spark):
    got = {x.doc_id: x for x in QUERIES["op3_document_fingerprints"](spark, SF).collect()}
    f = {k: int(x.fingerprint, 16) for k, x in got.items()}
    for k, x in got.items():
        want = sum((f[k] ^ v).bit_count() <= fingerprints.RADIUS for v in f.values()) - 1 if k % 20 == 0 else None
        assert x.n_within == want


def test_trie_in_parts():
    """A small frontier gives the same pairs."""
    r = np.random.default_rng(3)
    center = np.uint64(r.integers(1 << 62))
    flips = (np.uint64(1) << r.integers(0, 20, 300).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 20, 300).astype(np.uint64))
    v = np.unique(center ^ flips)
    group = np.zeros(len(v), np.int64)
    pairs = lambda n: {(min(x, y), max(x, y)) for a, b in neardup.trie_pairs(v, group, 2, n) for x, y in zip(a.tolist(), b.tolist(), strict=True)}
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if int(v[i] ^ v[j]).bit_count() <= 2}
    assert pairs(50) == pairs(10**6) == want
    assert len(neardup.forest(len(v), neardup.trie_pairs(v, group, 2, 50))) == len(v) - 1
