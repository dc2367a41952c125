"""Nulls, empty and long texts, repeated rows, empty tables, clashing names."""

import pytest

from hydrolith.llm import chat, extract, fingerprints, mixing, neardup, packing, pii, quality, rows, toxicity

CLASHING = ["_k", "_h", "k", "h", "row", "_s", "_o", "block", "blocks", "target", "source_size", "draws", "copies", "fingerprint", "pos", "shard", "_w", "_t", "_r", "noisy", "host", "node", "fp", "root", "component", "length", "n", "e", "t", "rows", "half", "toxic", "_d", "piece"]
TEXTS = [None, "", "   \n\t ", "one", "same words here", "same words here", "a b c d e f g h i j " * 3000, "é ß ẞ 漢字 x \U0001f600", "Mail a.b@c.de, call +49 30 1234567 8"]


@pytest.fixture(scope="module")
def odd(spark):
    made = [(i if i != 3 else None, t, None if i == 2 else "s" + str(i % 2), "en", None) for i, t in enumerate(TEXTS)]
    made += made[4:6] + [(None, None, None, None, None)]
    d = spark.createDataFrame(made, "doc_id long, text string, source string, lang string, n_chars long")
    for c in CLASHING:
        d = d.selectExpr("*", f"'x' AS `{c}`")
    return d


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1, 0), (4, 1, 0), (5, 0, 1), (6, 1, 0), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_packing(odd):
    got = packing.pack(odd).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert sum(r.length for r in got if r.doc_id == 0) == 1
    assert max(r.length for r in got) <= packing.CAPACITY
    assert packing.pack(odd.limit(0)).count() == 0


def test_toxicity(odd, labels):
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    kept = toxicity.kept(odd, labels)
    assert kept.columns == odd.columns
    none = toxicity.fit(odd, labels.limit(0))
    assert {r.score < 0.5 for r in toxicity.score(odd, none).collect()} == {True}
    assert toxicity.score(odd.limit(0), none).count() == 0


def test_fingerprints(odd):
    e = fingerprints.edited_fingerprints(odd)
    assert e.count() == odd.count()
    assert fingerprints.edited_fingerprints(odd.limit(0)).count() == 0
    assert fingerprints.edited_fingerprints(odd.filter("doc_id = 6")).count() == 1


def test_quality(odd):
    got = quality.quality(odd).collect()
    assert len(got) == odd.count()
    assert all(r.base_failed and not r.kept for r in got if r.n_words == 0)
    assert quality.quality(odd.limit(0)).count() == 0


def test_pii(odd):
    got = {r.doc_id: r for r in pii.find(odd).collect()}
    assert got[8].n_email == 1 and got[8].n_phone == 1 and got[0].spans == ""
    red = pii.redact(odd)
    assert red.columns == odd.columns and red.count() == odd.count()
    assert red.filter("doc_id = 8").first().text == "Mail <EMAIL>, call <PHONE>"
    assert pii.find(odd.limit(0)).count() == 0 and pii.redact(odd.limit(0)).count() == 0


def test_mixing(odd):
    m = mixing.mix(odd)
    assert m.columns == odd.columns
    m.collect()
    assert mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.filter("text IS NULL")).count() == 0


def test_rows(odd):
    got = rows.token_rows(odd).collect()
    assert sum(r.n_ids for r in got) == sum(x.length for x in packing.pack(odd).collect())
    assert rows.token_rows(odd.limit(0)).count() == 0


def test_neardup(odd):
    n = neardup.near_duplicates(odd)
    assert sum(r.copies for r in n.collect()) == odd.count()
    kept = neardup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert kept.filter("text = 'same words here'").count() == 1
    assert neardup.near_duplicates(odd.limit(0)).count() == 0 and neardup.deduplicated(odd.limit(0)).count() == 0


def test_extract(spark):
    p = spark.createDataFrame([(1, None, None), (2, "", ""), (None, "http://h/x", "<p>a &amp; b"), (4, "odd", "<div" * 2000), (4, "odd", "<div" * 2000)], "page_id long, url string, html string").selectExpr("*", "'x' AS text", "'x' AS host", "'x' AS noisy")
    got = extract.extract(p).collect()
    assert len(got) == 5 and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert [r.text for r in got if r.page_id is None] == ["a & b"]
    assert extract.extract(p.limit(0)).count() == 0


def test_chat(spark):
    c = spark.createDataFrame([(None, None, None, None), (1, 0, "USER ", None), (1, 0, "USER ", None), (2, None, "wizard", "x"), (3, 1, "system", "only")], "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS cost", "'x' AS rendered")
    got = chat.format_chats(c).collect()
    assert len(got) == 5
    assert {r.action for r in got if r.conv_id == 1} == {"keep", "merge"}
    assert [r.rendered for r in got if r.conv_id == 3] == ["<|system|>\nonly<|end|>\n<|user|>\n<|end|>\n"]
    assert chat.format_chats(c.limit(0)).count() == 0
