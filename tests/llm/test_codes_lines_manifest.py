"""Vector codes, line dedup and the manifest against plain versions."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hydrolith.llm import codes, lines, manifest


# Vector codes


@pytest.mark.parametrize("d,k,spread", [(1, 64, 3), (4, 64, 2), (4, 64, 400), (5, 7, 30), (3, 1, 9)])
def test_nearest_is_the_first_of_the_least(d, k, spread):
    g = np.random.default_rng(d * k + spread)
    x, book = g.integers(-spread, spread + 1, (300, d)), g.integers(-spread, spread + 1, (k, d))
    whole = ((x[:, None] - book[None]) ** 2).sum(2)
    index, least = codes.nearest(x, book)
    assert (index == whole.argmin(1)).all() and (least == whole.min(1)).all()


def plain_codes(rows):
    """The contract's codes, entry by entry."""
    kept = [(i, label, [int(np.floor(256 * np.float64(c))) for c in v]) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    size = max((len(r[2]) for r in kept), default=0)
    size = -(-size // 16)
    kept = [(i, label, v + [0] * (16 * size - len(v))) for i, label, v in kept]
    part = lambda v, p: v[p * size : (p + 1) * size]
    books = [[part(v, p) for _, _, v in kept[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    best = lambda p, a: min((far(a, e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        own = [[[] for _ in b] for b in books]
        for _, _, v in kept:
            for p in range(16):
                own[p][best(p, part(v, p))[1]].append(part(v, p))
        books = [[[sum(c) // len(of) for c in zip(*of, strict=True)] if of else e for e, of in zip(b, o, strict=True)] for b, o in zip(books, own, strict=True)]
    found = [(i, label, [best(p, part(v, p)) for p in range(16)]) for i, label, v in kept]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    error = [sum(d for d, _ in f) for _, _, f in found]
    of = {}
    for (_, label, _), e in zip(found, error, strict=True):
        of[label] = of.get(label, 0) + e
    return sorted(str((i, "".join(f"{k:02x}" for _, k in f), e, of[label], sha)) for (i, label, f), e in zip(found, error, strict=True))


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return df.selectExpr("*", "'x' AS code", "'x' AS error", "'x' AS _label", "'x' AS longest")


@pytest.mark.parametrize("n", [0, 1, 20, 150])
def test_codes(spark, n):
    """Nulls of every kind, repeated rows and ids, few vectors."""
    g = np.random.default_rng(n)
    rows = [(int(i), [float(x) for x in g.normal(0, 0.3, 32).astype(np.float32)], None if i % 5 == 0 else int(i % 3)) for i in range(n)]
    if n > 1:
        rows += rows[:5] + [(3, rows[7][1], 1), (None, rows[2][1], None), (900, None, 1), (901, [None] + rows[0][1][1:], 1), (902, [float("nan")] + rows[0][1][1:], 1), (903, [float("inf")] + rows[0][1][1:], 2)]
    got = codes.compress(vectors(spark, rows).repartition(3)).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_codes(rows)
    joined = codes.compress(vectors(spark, rows), few=0).collect()
    assert sorted(map(str, joined)) == sorted(map(str, got))


def test_odd_lengths_and_sizes(spark):
    """Lengths that differ, empty vectors, components beyond what a long can square."""
    rows = [(1, [0.5] * 20, 1), (2, [1.0] * 7, 1), (3, [], 1), (4, [1e30] * 20, 2), (5, [-1e30] * 20, None)]
    got = {r.vec_id: r for r in codes.compress(vectors(spark, rows)).collect()}
    assert len(got) == 5 and all(len(r.code) == 32 and r.error == 0 for r in got.values())
    assert [r.code for r in codes.compress(vectors(spark, [(1, [], 1), (2, [], 1)])).collect()] == ["00" * 16] * 2


# Lines


def plain_lines(docs, chars=40, least=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, text, *_ in docs:
        for x in (text or "").split("\n"):
            if len(key(x)) >= chars:
                held.setdefault(key(x), set()).add(i)
    keep = {k: max((i for i in ids if i is not None), default=None) for k, ids in held.items() if len(ids) >= least}
    out = []
    for i, text, *_ in docs:
        own = (text or "").split("\n")
        stays = [x for x in own if key(x) not in keep or keep[key(x)] == i]
        out.append((i, "\n".join(stays), len(own), len(own) - len(stays)))
    return sorted(map(str, out))


LONG = ["Shared line number %d, long enough to be counted by all" % k for k in range(30)]


@pytest.mark.parametrize("batches", [1, 4, 9])
def test_line_dedup(spark, batches):
    g = np.random.default_rng(batches)
    docs = []
    for i in g.permutation(80).tolist():
        own = [g.choice(["", "short", f"Only in document {i}, and in no other of them all", " \t" + LONG[g.integers(30)].upper() + "\r", LONG[g.integers(30)], LONG[g.integers(4)]]) for _ in range(g.integers(0, 12))]
        docs.append((i, "\n".join(own), "en"))
    docs += [(500, None, "en"), (501, "", "en"), (502, "\n\n", "en"), (None, "\n".join(LONG[:6]), "en"), (None, LONG[3], "en"), docs[4], docs[5]]
    docs += [(600 + k, "ÀÉ" * 20 + "\nàé" + "ÀÉ" * 19, "en") for k in range(5)] + [(700, "\n".join([LONG[1]] * 3000), "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").selectExpr("*", "1 AS pos", "2 AS h1", "3 AS batch", "4 AS gone", "5 AS n_lines")
    got = lines.dedup_lines(df.repartition(3), batches=batches).collect()
    assert sorted(str(tuple(r)) for r in got) == plain_lines(docs)


def test_no_lines(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert lines.dedup_lines(df).count() == 0
    one = spark.createDataFrame([(None, LONG[0])] * 7, "doc_id long, text string")  # rows without an id are one document
    assert {r.n_dropped for r in lines.dedup_lines(one).collect()} == {0}


def test_runs_are_levelled_and_disjoint(spark, tmp_path):
    """Nine batches, three runs to a level: the runs move up and no key is in two."""
    runs = lines.Runs(spark, str(tmp_path), 3)
    for k in range(9):
        batch = spark.range(k * 5, k * 5 + 10).selectExpr("id AS h1", "id * 7 AS h2", f"{100 - k}L AS doc_id")
        runs.add(batch.union(batch))
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    got = {r.h1: r.last for r in runs.rows().collect()}
    assert got == {i: 100 - max(0, min(8, (i - 5) // 5)) for i in range(50)} and runs.rows().count() == 50


# Manifest


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain_proofs(docs):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, s, lang, n, t: h(*map(field, (i, s, lang, n, t)))
    groups = {}
    for r in docs:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        rows = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[name] = rows, levels_of([leaf(*r) for r in rows])
    top = levels_of([trees[n][1][-1][0] for n in names])
    out = []
    for k, name in enumerate(names):
        rows, tree = trees[name]
        for j, r in enumerate(rows):
            changed = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded, proof = leaf(*r[:3], r[3] + 1, r[4]) if changed else leaf(*r), []
            for at, levels in ((j, tree), (k, top)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    proof.append(other)
                    folded, at = (h(other, folded) if at % 2 else h(folded, other)), at // 2
            out.append((r[0], leaf(*r), tree[-1][0], top[-1][0], h(*proof), folded, folded == top[-1][0]))
    return sorted(map(str, out))


def op13(df):
    return manifest.proofs(manifest.manifest(df, {"n_chars": F.col("n_chars") + 1}, F.crc32(F.col("doc_id").cast("string")) % 7 == 0))


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (5, 3, 1, 8), (2500, 1024, 1025, 7)])
def test_manifest(spark, sizes):
    """Trees within a block and beyond it, null languages, ids and texts, equal rows."""
    docs = []
    for g, n in enumerate(sizes):
        lang = [None, "en", "", "ß"][g]
        docs += [(10 * i + g, "s" if i % 3 else None, lang, i if i % 4 else None, f"text {i} é" if i % 5 else None) for i in range(n)]
    docs += [(None, None, sizes and "en", None, None)] * 3 + docs[:2]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_chars long, text string").selectExpr("*", "'x' AS tree", "'x' AS digest", "1 AS part", "2 AS i", "3 AS n")
    assert sorted(str(tuple(r)) for r in op13(df.repartition(5)).collect()) == plain_proofs(docs)


def test_manifest_of_nothing(spark):
    assert op13(spark.createDataFrame([], "doc_id long, source string, lang string, n_chars long, text string")).count() == 0


def test_numbers_without_broadcast(spark, tmp_path):
    rows = spark.range(300).selectExpr("CAST(id % 3 AS string) AS tree", "id % 50 AS doc_id")
    one, parts = manifest.numbered(rows, "tree", ["doc_id"], str(tmp_path / "a"))
    two, _ = manifest.numbered(rows, "tree", ["doc_id"], str(tmp_path / "b"), few=0)
    got = sorted(map(tuple, one.select("tree", "doc_id", "i", "n").collect()))
    assert got == sorted(map(tuple, two.select("tree", "doc_id", "i", "n").collect())) and parts >= 1
    for t in "012":
        own = sorted((i, d) for x, d, i, n in got if x == t and n == 100)
        assert [i for i, _ in own] == list(range(100)) and [d for _, d in own] == sorted(d for _, d in own)


def test_forests_are_a_monoid():
    """Any cut of the leaves, merged in any order, gives the roots."""
    g = np.random.default_rng(1)
    for n in (1, 2, 3, 7, 64, 100):
        leaves = [h(str(k)) for k in range(n)]
        want = levels_of(leaves)[-1][0]
        for _ in range(5):
            of = g.integers(0, 4, n)
            parts = []
            for p in range(4):
                f = manifest.Forest()
                for k in g.permutation(np.flatnonzero(of == p)).tolist():
                    f.add("t", n, 0, k, leaves[k])
                parts.append(f)
            order = g.permutation(4).tolist()
            left = parts[order[0]].merge(parts[order[1]]).merge(parts[order[2]].merge(parts[order[3]])) if g.random() < 0.5 else parts[order[3]].merge(parts[order[0]].merge(parts[order[1]]).merge(parts[order[2]]))
            assert [x[4] for x in left.told if x[5] == manifest.ROOT] == [want] and not left.nodes
