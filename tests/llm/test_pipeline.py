import collections

import corpus_pipeline
from cueloom.llm import pieces
from tests.llm.test_rules_pii_licenses import base_spans
from tests.llm.test_similar import kept_by_brute_force


def test_every_stage_on_its_input(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before, names = {r.doc_id: r for r in docs.collect()}, docs.columns
    results = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        results[name] = docs.collect()
        if name != "encoding":
            assert docs.columns == names
    kept = {r.doc_id for r in results["quality"]}
    assert all(len((before[d].text or "").split()) >= 20 for d in kept) and 0 < len(kept) < len(before)
    once = {r.doc_id for r in results["near_duplicates"]}
    assert sorted(once) == kept_by_brute_force([(d, before[d].text) for d in sorted(kept)])
    clean = {r.doc_id: r for r in results["personal_data"]}
    assert set(clean) == once and not any(base_spans(r.text) for r in clean.values())
    assert all(r.text == before[d].text for d, r in clean.items() if not base_spans(before[d].text) and "token" not in before[d].text)
    taken = collections.Counter(r.doc_id for r in results["source_mix"])
    assert set(taken) <= once and max(taken.values()) <= 2
    encoder = pieces.Encoder(pieces.load_pieces())
    import numpy as np

    got = collections.Counter((r.doc_id, encoder.decode(np.array(r.ids, np.int32))) for r in results["encoding"])
    assert got == collections.Counter((r.doc_id, r.text) for r in results["source_mix"])
    run = corpus_pipeline.run(spark, sf_dir).collect()
    assert collections.Counter(map(repr, run)) == collections.Counter(map(repr, results["encoding"]))


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
