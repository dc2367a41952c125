"""Each stage against what its operator says of each document."""

from collections import Counter

import corpus_pipeline
from hydrolith.llm import mixing, neardup, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixing", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert out.dtypes == docs.dtypes
        if name == "toxicity":
            model = toxicity.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
            want = {r.doc_id for r in toxicity.score(before, model).collect() if r.score < 0.5}
            assert {r.doc_id for r in out.collect()} == want
        if name == "near_duplicates":
            want = {r.component for r in neardup.near_duplicates(before).collect()}
            assert sorted(r.doc_id for r in out.collect()) == sorted(want)
        if name == "personal_data":
            w = pii.weights()
            own = {r.doc_id: r.text for r in before.collect()}
            for r in out.collect():
                base = pii.base_spans(own[r.doc_id])
                assert r.text == pii.masked(own[r.doc_id], base + pii.added_spans(own[r.doc_id], base, w)) and r.n_chars == len(r.text)
        if name == "mixing":
            sized = mixing.sized(before).cache()
            want = Counter({r.doc_id: len(r.draws) for r in mixing.drawn(sized, mixing.draws(sized)).collect()})
            assert Counter(r.doc_id for r in out.collect()) == +want
        if name == "packing":
            room = Counter()
            for r in out.collect():
                room[r.sequence_id] += r.length
            assert max(room.values()) <= 4096
            assert Counter(r.doc_id for r in out.filter("piece = 0").collect()) == Counter(r.doc_id for r in before.collect())
        before = out


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
