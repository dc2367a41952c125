"""The pipeline's rows by plain rules that call none of its stages' functions."""

import re
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hydrolith.llm import tokens

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's rows, from documents with nulls, repeats and clashing columns."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "twice the same few words", "en", "s", 24), (9001, "twice the same few words", "en", None, 24), (9001, "", "en", "s", 0), (9002, "   ", None, "s", None), (9003, "write to someone@example.org or +49 30 1234567 8 today", "en", "s", 50)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(odd).selectExpr("*", "'x' AS score", "'y' AS component", "'z' AS draws", "1 AS piece", "2 AS length")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(base / name))
        out.append(spark.read.parquet(str(base / name)))
    return [(x.columns, x.collect()) for x in out]


def test_columns_stay(stages):
    assert all(columns == stages[0][0] for columns, _ in stages[:5])


def fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def test_one_of_each_group(stages):
    """By fingerprints of all pairs; the first of a group stays, and nothing else goes."""
    before, after = stages[1][1], stages[2][1]
    prints = sorted({fingerprint(r.text) for r in before})
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    group = {p: find(i) for i, p in enumerate(prints)}
    assert Counter(group[fingerprint(r.text)] for r in after) == Counter({g: 1 for g in group.values()})
    assert not Counter(map(tuple, after)) - Counter(map(tuple, before))


def test_clean_documents_stay(stages):
    """The first stage takes few; those labelled clean, and odd rows, stay."""
    import pyarrow.parquet as pq

    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    gone = Counter(r.doc_id for r in stages[0][1]) - Counter(r.doc_id for r in stages[1][1])
    clean = [i for i, t in labels.items() if t == 0]
    assert sum(i in gone for i in clean) <= 0.02 * len(clean) and not {None, 9001, 9002, 9003} & gone.keys()


def test_personal_data_is_masked(stages):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    before, after = stages[2][1], stages[3][1]
    assert sorted(str(r.doc_id) for r in before) == sorted(str(r.doc_id) for r in after)
    assert any(email.search(r.text or "") for r in before) and not any(email.search(r.text or "") for r in after)
    texts = {r.doc_id: r.text for r in after}
    if 9003 in texts:
        assert texts[9003] == "write to <EMAIL> or <PHONE> today"


def test_mix_is_bounded(stages):
    before, after = stages[3][1], stages[4][1]
    size = lambda r: len(WORD.findall(r.text or ""))
    times, there = Counter(map(tuple, after)), Counter(map(tuple, before))
    assert all(times[x] <= 3 * there[x] for x in times) and not times.keys() - there.keys()
    taken, held = defaultdict(int), defaultdict(int)
    for r in after:
        taken[r.source] += size(r)
    for r in before:
        held[r.source] += size(r)
    assert all(taken[s] <= 3 * held[s] + max(map(size, before)) for s in taken)
    total = sum(held.values())
    assert abs(sum(taken.values()) - total) <= 0.1 * total


def test_pieces_are_the_documents(stages):
    """Each document's ids by the tokenizer itself, cut at 4,096, without gaps."""
    t = Tokenizer.from_file(tokens.vocabulary_path(tokens.VOCABULARY))
    want = Counter()
    for r in stages[4][1]:
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            own = ids[at : at + 4096]
            want[r.doc_id, n, at, len(own), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own))] += 1
    rows = stages[5][1]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(own[-1]) <= 4096


def test_stages_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_a_failed_run_leaves_no_folders(spark, monkeypatch, tmp_path):
    def fails(spark, docs, sf_dir):
        return docs.select(F.raise_error(F.lit("stage")).alias("doc_id"))

    monkeypatch.setattr(corpus_pipeline, "shared_dir", lambda spark: str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("one", lambda s, d, p: d), ("two", fails)])
    with pytest.raises(Exception, match="stage"):
        corpus_pipeline.run(spark, SF)
    assert not list(tmp_path.glob("pipeline-*"))
