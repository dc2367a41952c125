"""Quality rules, personal data and mixing against plain Python."""

import hashlib
import re
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from hydrolith.llm import mixing, pii
from hydrolith.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_base_measures(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op5_quality_rules"](spark, SF).collect():
        t = docs[r.doc_id]
        w = WORD.findall(t)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        covered = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", t)) and r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == len(covered)
        assert r.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w))
        assert not (r.base_failed and r.kept)


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    """The base rules as their patterns stand."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        s = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 13 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab@.-+0123456789 ()_%,é\n", max_size=60))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_pii_whole_table(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op7_pii"](spark, SF).collect():
        want = plain_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert Counter(k for k, *_ in want) == Counter({"email": r.n_email, "ip": r.n_ip, "card": r.n_card, "phone": r.n_phone}) - Counter()
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s)]
        assert set(want) <= set(spans)


def test_field_on_held_out_sentences():
    """Spans of made-up sentences that the fit has not seen."""
    w = pii.weights()
    found = true = right = 0
    for seed in range(10_000, 10_300):
        text, spans = pii.made_up(seed)
        base = pii.base_spans(text)
        got = set(base) | set(pii.added_spans(text, base, w))
        true, found, right = true + len(spans), found + len(got), right + len(got & set(spans))
    assert right / true > 0.9 and right / found > 0.85


def test_dynamic_programming_against_enumeration():
    import itertools

    edges = [(0, 2, 1.0), (1, 3, 1.5), (2, 4, 0.7), (0, 1, 0.2), (3, 4, 0.4), (0, 4, 1.6)]

    def legal(c):
        spans = sorted(edges[i][:2] for i in c)
        return all(a[1] <= b[0] for a, b in itertools.pairwise(spans))

    sets = [c for n in range(len(edges) + 1) for c in itertools.combinations(range(len(edges)), n) if legal(c)]
    top = max(sets, key=lambda c: sum(edges[i][2] for i in c))
    assert sorted(pii.best(4, edges)) == sorted(top)
    import math

    z = sum(math.exp(sum(edges[i][2] for i in c)) for c in sets)
    log_z, p = pii.marginals(4, edges)
    assert abs(log_z - math.log(z)) < 1e-9
    for k in range(len(edges)):
        want = sum(math.exp(sum(edges[i][2] for i in c)) for c in sets if k in c) / z
        assert abs(p[k] - want) < 1e-9


def plain_targets(sizes: dict) -> dict:
    """Shares by 5, 2, 1; what is over three times a size is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out: dict = {}
    while True:
        left, of = sum(sizes.values()) - sum(out.values()), sum(weight[s] for s in order if s not in out)
        full = {s: 3.0 * sizes[s] for s in order if s not in out and left * weight[s] / of > 3 * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / of for s in order if s not in out}
        out |= full


def spark_targets(spark, sizes: dict) -> dict:
    rows = [("n" if s is None else f"s{s}", z) for s, z in sizes.items()]
    got = mixing.with_targets(spark.createDataFrame(rows, "_s string, source_size long")).collect()
    return {None if r._s == "n" else r._s[1:]: r.target for r in got}


def test_targets_by_hand(spark):
    assert spark_targets(spark, {"a": 100, "b": 100, None: 100}) == {"a": 187.5, "b": 75.0, None: 37.5}
    got = spark_targets(spark, {"a": 10, "b": 100, "c": 100})
    assert got["a"] == 30.0 and abs(got["b"] - 120) < 1e-9 and abs(got["c"] - 60) < 1e-9
    assert spark_targets(spark, {}) == {} and spark_targets(spark, {"a": 0}) == {"a": 0.0}


def test_targets_of_many_sources(spark):
    sizes = {f"{chr(0x10FFFF - i)}{i}" if i % 3 else f"s{i}": (i * 7919 % 1000) ** 2 for i in range(400)} | {None: 3, "": 2}
    got, want = spark_targets(spark, sizes), plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
    assert all(t <= 3 * sizes[s] for s, t in got.items()) and abs(sum(got.values()) - sum(sizes.values())) < 1e-3


def test_many_sources_without_broadcast(spark, monkeypatch):
    """300 sources, one of them with a third of all rows; same rows either way."""
    rows = [(i, "big" if i % 3 == 0 else f"s{i % 299}", "w " * (i % 7)) for i in range(9000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")

    def run():
        s = mixing.sized(docs).cache()
        return {r.doc_id: r for r in mixing.drawn(s, mixing.draws(s)).collect()}

    few = run()
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    many = run()
    digest = lambda out: {i: (r.source_size, r.target, sorted(map(tuple, r.draws))) for i, r in out.items()}
    assert len(few) == 9000 and digest(few) == digest(many)
    taken, target, largest = Counter(), {}, {}
    for r in few.values():
        taken[rows[r.doc_id][1]] += r.size * len(r.draws)
        target[rows[r.doc_id][1]] = r.target
    assert all(abs(taken[s] - t) <= 6 for s, t in target.items())
    assert {d.shard for r in few.values() for d in r.draws} <= set(range(64))


def test_shares_are_dealt_whole(spark):
    quotas = spark.createDataFrame([(0, "a", 5), (0, "b", 3), (1, "c", 4)], "g int, _s string, quota long")
    shares = spark.createDataFrame([(0, 0, 2), (0, 1, 6), (1, 0, 1), (1, 3, 3)], "g int, shard int, n long")
    got = mixing.dealt(quotas, shares, 1).collect()
    assert sorted((r._s, r.pos) for r in got) == [(s, i) for s, n in (("a", 5), ("b", 3), ("c", 4)) for i in range(n)]
    assert Counter(r.shard for r in got if r._s != "c") == {0: 2, 1: 6} and [r.shard for r in sorted(got) if r._s == "c"] == [0, 3, 3, 3]
    for s in "ab":
        own = [r.shard for r in sorted(got) if r._s == s]
        assert own == sorted(own)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=5), st.sampled_from([1, 2, 4, 7]))
def test_tree_keeps_the_quotas(quotas, shards):
    tree = mixing.split_tree(quotas, shards, 1)
    assert tree.shape == (shards, len(quotas)) and tree.min() >= 0
    assert tree.sum(0).tolist() == quotas
    sizes = tree.sum(1)
    assert sizes.max() - sizes.min() <= 1 + shards.bit_length()


def test_mix_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op8_source_mixing"](spark, sf).collect()
    assert sorted(map(str, got)) == sorted(map(str, QUERIES["op8_source_mixing"](spark, sf).collect()))
    by: dict = {}
    for r in got:
        assert r.size == len(WORD.findall(docs[r.doc_id].text or "")) and r.taken in {k * r.size for k in range(4)}
        t = by.setdefault(docs[r.doc_id].source, [r.source_size, r.target, 0, 0])
        t[2], t[3] = t[2] + r.taken, max(t[3], r.size)
    want = plain_targets({s: v[0] for s, v in by.items()})
    for s, (_, target, taken, largest) in by.items():
        assert abs(target - want[s]) < 1e-6
        assert abs(taken - target) <= max(0.02 * target, largest)
    assert len(got) == len(docs)


def test_mix_has_each_draw(spark):
    sf = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = Counter(r.doc_id for r in mixing.mix(table).select("doc_id").collect())
    for r in QUERIES["op8_source_mixing"](spark, sf).collect():
        assert mixed[r.doc_id] == len(r.shards)
        assert r.size == 0 or r.taken == r.size * len(r.shards)


def test_added_spans_come_once():
    w = pii.weights()
    line = "a(at)b.example.org"
    for text in ("\n".join([line] * 3), " ".join([line] * 3), " ".join([line] * 3)):
        assert [text[a:b] for _, a, b in pii.added_spans(text, [], w)] == [line] * 3
    assert [x[0] for x in pii.added_spans("write foo at bar dot org", [], w)] == ["email"]
    # Regions are apart and in order, and no longer than what they read around a trigger.
    text = "x" * 1000 + "@" + "y" * 1000 + "7" + "z" * 1000
    found = pii.regions(text)
    assert [b - a for a, b in found] == [2 * (pii.AROUND + pii.FURTHER) + 1] * 2 and found[0][1] <= found[1][0]


def test_field_takes_linear_time():
    w = pii.weights()
    lines = lambda n: "\n".join(f"会員{i}番(foo{i}(at)bar.example.org)電話0301234{i:05d}" for i in range(n))
    took = {}
    for n in (1000, 4000):
        begun = time.process_time()
        spans = pii.added_spans(lines(n), [], w)
        took[n] = time.process_time() - begun
        assert len(spans) == len(set(spans)) >= n
    assert took[4000] < 8 * took[1000]


def test_whole_phone_is_found():
    text = "Des +1 (826) 555-4081 190.137.223.4"
    base = pii.base_spans(text)
    assert [text[a:b] for k, a, b in pii.added_spans(text, base, pii.weights())] == ["+1 (826) 555-4081"]
