import collections
import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cueloom.llm import ann, components, queries, simhash, suffix_dedup


def plain_fingerprint(text):
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


TEXTS = [None, "", " ", "One two", "one TWO", "É a b c", "é a b c", "a b c d e", "a b c d e", "a " * 70_000, "  x"]


def test_fingerprints_and_components_of_odd_rows(spark):
    rows = [(10 - i, t, "f") for i, t in enumerate(TEXTS)] + [(None, "one two", "f"), (3, "a b c d e", "f"), (3, "a b c d e", "f")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    f = [plain_fingerprint(t) for _, t, _ in rows]
    comp = least_reachable(range(len(rows)), [(i, j) for i in range(len(rows)) for j in range(i) if bin(f[i] ^ f[j]).count("1") <= 2])
    least = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            least[comp[i]] = min(d, least.get(comp[i], d))
    want = sorted((repr(d), f"{f[i]:016x}", repr(least.get(comp[i]))) for i, (d, _, _) in enumerate(rows))
    assert sorted((repr(r.doc_id), r.fingerprint, repr(r.component_id)) for r in got) == want
    kept = simhash.keep_one(frame).collect()
    assert sorted(repr(r.doc_id) for r in kept) == sorted(repr(x) for x in least.values()) and kept[0].fp == "f"
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [0, 3, 50])
def test_links_have_the_components_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(hot)
    fps = set()
    for _ in range(12):
        base = rng.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    frame = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = {r.node: r.component for r in components.components(simhash.links(frame)).collect()}
    pairs = [(signed(a), signed(b)) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    want = least_reachable([signed(x) for x in fps], pairs)
    assert all(got.get(x, x) == want[x] for x in want)


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in components.components(edges).collect()} == {0}


def brute_removal(texts):
    seen, n = collections.Counter(), suffix_dedup.LENGTH
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for i in range(len(b) - n + 1):
            seen[b[i : i + n]] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        runs = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[0])
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])).hexdigest()))
    return out


@pytest.mark.parametrize("hot,block", [(256, 1_000_000), (1, 1_000_000), (3, 20_000)])
def test_repeats_against_brute_force(spark, monkeypatch, hot, block):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = random.Random(5)
    some = lambda n, letters="abcdé ": "".join(rng.choices(letters, k=n))
    base = some(3000)
    rows = [(1, base[:1000]), (2, base[300:1300] + "x"), (3, "a" * 900), (4, "a" * 399), (5, None), (6, ""), (7, base[:1000]), (7, base[:1000]), (None, base[500:950]), (8, base[:450] + "Z" + base[451:1200]), (9, "ab" * 500), (10, base[2000:2500] * 3), (11, "q" * 10 + base[100:520] + "w" * 10)]
    rows += [(100 + i, some(200, "uvwxyz") + base[1500 : 1905 + i % 7] + some(200, "uvwxyz")) for i in range(40)]
    frame = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k1 int")
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(frame).collect())
    assert got == collections.Counter((d, *x) for (d, _), x in zip(rows, brute_removal([t for _, t in rows]), strict=True))


def test_repeats_of_documents_and_of_nothing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    local = docs.collect()
    want = {d: x for (d, _), x in zip(local, brute_removal([t for _, t in local]), strict=True)}
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op10_repeats(spark, sf_dir).collect()} == want
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_recall_and_exact_scores(spark):
    folder = "/root/testdata/sf0.01"
    local = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ids = np.array([r.vec_id for r in local])
    v = np.array([r.embedding for r in local], np.float32).astype(np.float64)
    got = queries.op6_nearest(spark, folder).collect()
    found = collections.defaultdict(dict)
    at = {i: k for k, i in enumerate(ids)}
    for r in got:
        found[r.query_id][r.rank] = r.vec_id
        assert abs(r.score - v[at[r.query_id]] @ v[at[r.vec_id]]) < 1e-12
    hits = total = 0
    for q in ids[ids % 20 == 0]:
        s = v @ v[at[q]]
        order = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits += len(set(order) & set(found[q].values()))
        total += 20
    assert hits / total > 0.95


def test_shards_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(1000 + i, [1.0] * 8) for i in range(100)]
    rows += [(2000, None), (2020, [0.0] * 8), (2040, [float("nan")] * 8), (2060, [None] * 8), (None, [1.0] * 8), (2080, [1.0] * 3), (1000, [1.0] * 8), (2100, [float("inf")] + [0.0] * 7)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = collections.defaultdict(list)
    for r in sorted(ann.nearest(frame, F.col("vec_id") % 20 == 0, shard=100).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    assert set(got) == {i for i, _ in rows if i is not None and i % 20 == 0 and i < 2000}
    good = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and i < 2000}
    hits = 0
    for q, found in got.items():
        want = sorted((i for i in good if i != q), key=lambda i: (-(good[i] @ good[q]), i))[:20]
        hits += len(set(want) & set(found))
        if q >= 1000:
            alike = [i for i in want if i >= 1000]
            assert [i for i in found if i >= 1000] == alike
    assert hits / (20 * len(got)) > 0.9
    assert ann.nearest(frame.limit(0), F.lit(True)).count() == 0
    few = spark.createDataFrame([(20, [1.0, 0.0]), (21, [0.5, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(few, F.col("vec_id") == 20).collect()] == [(20, 1, 21)]


def recall_of(v, q, found, k=20):
    s = v[q] @ v.T
    hits = 0
    for i, row in enumerate(found):
        row = row[row >= 0]
        hits += len(set(row[np.argsort(-s[i][row])][:k]) & set(np.argsort(-s[i])[:k]))
    return hits / (k * len(q))


def test_recall_of_a_full_shard():
    v = np.random.default_rng(4).normal(size=(ann.SHARD, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    q = np.arange(0, ann.SHARD, 40)
    graph = ann.build(ann.level_off(v))
    found, _ = ann.search(graph, np.concatenate([v[q], np.zeros((len(q), 1))], axis=1).astype(np.float32))
    assert recall_of(v, q, found) > 0.95
    assert all((g.max() < ann.SHARD) and (g[:, 0] >= 0).sum() >= (graph.level >= k).sum() - 1 for k, g in enumerate(graph.neighbours))


@pytest.mark.parametrize("factor", [1.0, 1e200])
def test_recall_of_many_shards_and_unequal_lengths(spark, monkeypatch, factor):
    monkeypatch.setattr(ann, "TOGETHER", 1)
    monkeypatch.setattr(ann, "QUERIES", 64)
    rng = np.random.default_rng(6)
    n = 5000
    v = rng.normal(size=(n, 32)) * rng.lognormal(size=(n, 1)) * factor
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in ann.nearest(frame, F.col("vec_id") % 20 == 0, shard=512).collect():
        found[r.query_id].append(r.vec_id)
    hits = 0
    with np.errstate(over="ignore"):
        for q, got in found.items():
            s = (v / factor) @ (v[q] / factor)
            s[q] = -np.inf
            hits += len(set(got) & set(np.argsort(-s)[:20]))
    assert len(found) == n // 20 and all(len(x) == 20 for x in found.values())
    assert hits / (20 * len(found)) > (0.9 if factor == 1.0 else 0.0)
