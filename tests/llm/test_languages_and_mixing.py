import random

from pyspark.sql import functions as F

from cueloom.llm import language_id, mixing, queries
from tests.comparing import same_rows


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in queries.op3_language_id(spark, folder).collect() if r.held_out]
    assert len(held) > 100
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in held)


ENGLISH = "the weather was nice and they went with their friends to the river in the morning"
RUSSIAN = "погода была хорошая и они пошли вместе на реку рано утром чтобы там купаться"
GERMAN = "das wetter war schön und sie gingen mit ihren freunden am morgen an den fluss zum schwimmen"


def test_spans_and_odd_rows(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([(ENGLISH, "en"), (RUSSIAN, "ru"), (GERMAN, "de")] * 5)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "ru"]
    odd = [(1, f"{ENGLISH}. {RUSSIAN}. {GERMAN}", "x"), (2, None, "x"), (3, "", "x"), (4, "123 !?", "x"), (5, ENGLISH * 2000, "x"), (5, ENGLISH * 2000, "x"), (None, "日本", "x")]
    frame = spark.createDataFrame(odd, "doc_id long, text string, score string")
    got = language_id.predict(frame, model).collect()
    assert [s.lang for s in got[0].lang_spans] == ["en", "ru", "de"]
    first = got[0].lang_spans[0]
    assert odd[0][1][first.start : first.end] == ENGLISH
    assert [(r.lang_pred, r.score) for r in got[1:4]] == [("und", 0.0)] * 3
    assert got[4].lang_pred == got[5].lang_pred == "en" and got[6].lang_pred in model.langs
    assert language_id.predict(frame.limit(0), model).count() == 0
    nothing = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.predict(frame, nothing).collect()} == {"und"}


def test_viterbi_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    lengths = np.array([3, 0, 5, 1])
    scores = rng.normal(size=(9, 3)).astype(np.float32) * 3
    got, at = language_id.viterbi(scores, lengths, 2.0), 0
    for n in lengths:
        value = lambda path: sum(scores[at + i, p] for i, p in enumerate(path)) - 2.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        if n:
            assert tuple(got[at : at + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)
        at += n


def test_mixing_equals_sql(spark, sf_dir):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        same_rows(queries.op5_mixing(spark, folder), mixing.ORACLE_SQL, folder)


def filled(sizes):
    """Targets by sharing again and again, as the rule is stated."""
    names = sorted([s for s in sizes if s is not None]) + ([None] if None in sizes else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        left = total - sum(2 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return share | {s: 2.0 * sizes[s] for s in capped}
        capped |= over


def test_targets_copies_and_odd_rows(spark):
    rng = random.Random(3)
    sources = ["b", "a", None, "ü", "c", "", "d", "e"]
    rows = [(i, rng.choices(sources, weights=[30, 5, 2, 1, 8, 1, 1, 3])[0], " ".join(["w"] * rng.randint(0, 60)), 5) for i in range(3000)]
    rows += [(9001, "a", None, 5), (9002, "only", "", 5), (None, "a", "x y", 5), (9003, "a", "x y", 5), (9003, "a", "x y", 5)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, text string, size int")
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, s, t, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want, taken = filled(sizes), {}
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
        assert r.size == len((r.text or "").split()) and r.taken == r.copies * r.size and 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    key = lambda r: repr(tuple(r))
    again = mixing.mix(frame.repartition(7)).collect()
    assert sorted(map(key, again)) == sorted(map(key, got))
    assert mixing.mix(frame.limit(0)).count() == 0
    assert mixing.resampled(frame).count() == sum(r.copies for r in got)
    assert mixing.resampled(frame).columns == frame.columns


def test_large_tables_of_sources_are_joined_by_shuffle(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.concat("source", F.lit("x")))
    want = sorted(map(repr, mixing.mix(docs, carry=["doc_id"]).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(repr, mixing.mix(docs, carry=["doc_id"]).collect())) == want


def test_frequencies_follow_the_odds(spark):
    """Of documents of one expected number of copies, as many copies are taken on average, and lengths differ in it."""
    rng = random.Random(11)
    rows = [(i, "ab"[i % 3 == 0], " ".join(["w"] * rng.choice([3, 12, 50, 200, 800]))) for i in range(9000)]
    rows.append((9999, "c", "w " * 300_000))
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), carry=["doc_id", "source"]).collect()
    groups = {}
    for r in got:
        groups.setdefault((r.source, r.expected), []).append(r)
    assert len({e for s, e in groups if s == "a"}) == 5
    for (_, expected), rs in groups.items():
        copies = [r.copies for r in rs]
        assert all(c in (int(expected), int(expected) + 1) for c in copies)
        if len(rs) > 100:
            p = expected - int(expected)
            assert abs(sum(copies) / len(rs) - expected) < 4 * (p * (1 - p) / len(rs)) ** 0.5 + 0.02
    for source in "ab":
        rs = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
