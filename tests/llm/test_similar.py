import random

import pytest

import corpus_pipeline
from cueloom.llm import similar
from tests.llm.test_duplicates_and_neighbours import least_reachable


def shingle_set(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def kept_by_brute_force(rows):
    sets = [shingle_set(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root, least = least_reachable(range(len(rows)), pairs), {}
    for i, (d, _) in enumerate(rows):
        least[root[i]] = min(d, least.get(root[i], d))
    return sorted(least.values())


@pytest.mark.parametrize("sample,frequent", [(5000, 3), (20, 1)])
def test_stage_against_brute_force_jaccard(spark, sf_dir, monkeypatch, sample, frequent):
    monkeypatch.setattr(similar, "SAMPLE", sample)
    monkeypatch.setattr(similar, "FREQUENT", frequent)
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, line = [], some(30)
    for _ in range(30):
        base = some(200)
        texts.append(base)
        for changes in (1, 2, 3, 4, 5):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(200)] = "new"
            texts.append(copy)
        texts.append(base[:150] + line)
        texts.append(base + some(rng.randrange(70)))
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000, None), (1001, ""), (1002, "one two"), (1003, "One  TWO"), (1004, rows[0][1].upper())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, frame, sf_dir).collect())
    assert got == kept_by_brute_force(rows)


def test_stage_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert got == kept_by_brute_force(rows)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_family_of_near_copies_leaves_few_candidates(spark, monkeypatch):
    """Copies with many edits, alike or not: fewer pairs are compared last than there are copies."""
    monkeypatch.setattr(similar, "SAMPLE", 160)
    made, apart = [], similar._still_apart

    def counted(joined):
        out = apart(joined)
        made.append(out.count())
        return out

    monkeypatch.setattr(similar, "_still_apart", counted)
    rng = random.Random(5)
    base, texts = [f"w{i}" for i in range(200)], []
    for k in range(160):
        copy = list(base)
        for at in rng.sample(range(200), k % 10):
            copy[at] = f"e{rng.randrange(10**9)}"
        texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = sorted(r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == kept_by_brute_force(rows)
    assert made[0] < 160


def test_few_rows_take_few_tasks_however_many_partitions(spark):
    """Steps are many, so tasks (and their files) must follow the rows, not steps times partitions."""
    rng, conf = random.Random(3), {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    base = [f"w{i}" for i in range(100)]
    rows = [(i, " ".join(base[:at] + [f"e{i}"] + base[at:])) for i, at in enumerate(rng.choices(range(101), k=40))]
    context, before = spark.sparkContext, {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for k, v in conf.items():
        spark.conf.set(k, v)
    context.setJobGroup("few-rows", "")
    try:
        got = sorted(r.doc_id for r in similar.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == kept_by_brute_force(rows)
    seen = context.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup("few-rows") for s in seen.getJobInfo(j).stageIds}
    assert sum(info.numTasks for s in stages if (info := seen.getStageInfo(s))) < 6000
