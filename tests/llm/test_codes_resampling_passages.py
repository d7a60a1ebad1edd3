import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from cueloom.llm import codes, queries, resampling, substring_dedup
from tests.comparing import same_rows


@pytest.mark.parametrize("name", ["op11_codes", "op12_resampling", "op13_passages"])
def test_queries_equal_sql(spark, sf_dir, name):
    for folder in (sf_dir, "/root/testdata/sf0.01"):
        same_rows(queries.QUERIES[name](spark, folder), queries.ORACLES[name], folder)


# codes


def nearest_by_all_pairs(parts, entries):
    distance = ((parts[:, None, :] - entries[None]) ** 2).sum(axis=2)
    return distance.argmin(axis=1), distance.min(axis=1)


@pytest.mark.parametrize("spread", [1, 3, 1000, 1 << 20])
def test_exponion_search_equals_all_pairs(spread):
    rng = np.random.default_rng(spread)
    for width in (1, 4):
        entries = rng.integers(-spread, spread + 1, (64, width))
        entries[10] = entries[3]  # of equal entries the first is taken
        parts = np.concatenate([rng.integers(-spread, spread + 1, (500, width)), entries[:20], (entries[:20] + entries[20:40]) // 2])
        got = codes.Codebook(entries).nearest(parts, rng.integers(0, 64, len(parts)))
        want = nearest_by_all_pairs(parts, entries)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()


def test_exponion_search_looks_at_few_entries(monkeypatch):
    rng = np.random.default_rng(1)
    entries = rng.integers(-10_000, 10_000, (64, 4))
    parts = entries[rng.integers(0, 64, 2000)] + rng.integers(-50, 50, (2000, 4))
    book = codes.Codebook(entries)
    before = nearest_by_all_pairs(parts, entries)[0]
    start = ((parts - entries[before]) ** 2).sum(axis=1)
    seen = [np.searchsorted(book.far[b], 4 * s, side="right") for b, s in zip(before, start, strict=True)]
    assert np.mean(seen) < 3
    monkeypatch.setattr(codes, "PAIRS", 7)
    assert (book.nearest(parts, before)[0] == before).all()


def compressed_by_hand(rows):
    """Codes, errors and entries of rows of one width, by all pairs and Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = {i: [math.floor(256 * x) for x in r[1]] for i, r in enumerate(rows)}
    order = sorted(ints, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    width = len(ints[order[0]]) // 16
    part = lambda i, p: ints[i][p * width : (p + 1) * width]
    books = [[part(i, p) for i in order[:64]] for p in range(16)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda i, p: min((far(part(i, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(2):
        code = {(i, p): find(i, p)[1] for i in ints for p in range(16)}
        for p in range(16):
            for k in range(len(books[p])):
                mine = [part(i, p) for i in ints if code[i, p] == k]
                if mine:
                    books[p] = [*books[p][:k], [sum(c) // len(mine) for c in zip(*mine, strict=True)], *books[p][k + 1 :]]
    found = {i: [find(i, p) for p in range(16)] for i in ints}
    error = {i: sum(d for d, _ in found[i]) for i in ints}
    label = collections.Counter()
    for i in ints:
        label[rows[i][2]] += error[i]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((rows[i][0], "".join(f"{k:02x}" for _, k in found[i]), error[i], label[rows[i][2]], digest) for i in ints), key=repr)


def test_codes_of_odd_vectors(spark):
    rng = random.Random(5)
    some = lambda: [rng.choice([-1.5, -0.25, 0.0, 0.1, 0.3, 2.0, rng.gauss(0, 1)]) for _ in range(32)]
    rows = [(rng.randrange(60), some(), rng.choice([None, 1, 2])) for _ in range(150)]
    rows += [rows[0]] * 3 + [(1, None, 1), (2, [None] * 32, 2), (3, [math.nan] * 32, 1), (4, [math.inf] + [0.0] * 31, 1), (None, some(), None), (70, [0.0] * 32, None)]
    schema = "vec_id long, embedding array<double>, label int, code string, error int"
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    read = lambda f: sorted((tuple(r) for r in f.collect()), key=repr)
    assert read(codes.compress(frame)) == compressed_by_hand(rows)
    few = rows[:5]
    assert read(codes.compress(spark.createDataFrame([(*r, "x", 1) for r in few], schema))) == compressed_by_hand(few)
    assert codes.compress(frame.limit(0)).collect() == []
    # vectors that do not fit stay, without a code
    other = [(0, [0.5] * 32, 1), (1, [0.5] * 16, 1), (2, [], 1), (3, [1e30] * 32, 2), (4, [0.25] * 32, 1)]
    got = {r.vec_id: r for r in codes.compress(spark.createDataFrame(other, "vec_id long, embedding array<double>, label int")).collect()}
    assert {k: r.code for k, r in got.items()} == {0: "00" * 16, 1: None, 2: None, 3: None, 4: "01" * 16}
    assert got[4].error == 0 and got[3].label_error is None and got[1].label_error == 0
    odd = codes.compress(spark.createDataFrame([(0, [1.0] * 5, 1)], "vec_id long, embedding array<double>, label int")).collect()
    assert [(r.vec_id, r.code, r.error) for r in odd] == [(0, None, None)]


# resampling


def resampled_by_hand(docs, target):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    bucket = lambda w: zlib.crc32(w.encode()) % 10_000
    s, t = (collections.Counter(bucket(w) for x in texts for w in words(x)) for texts in ([d[1] for d in docs], target))
    n, m = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000))))
    rows = []
    for key, text in docs:
        own = words(text)
        weight = sum(gain(bucket(w)) for w in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    draw = len(order) * 10 // 100
    return sorted([(*r, k if k <= draw else None) for k, r in enumerate(order, 1)] + [(*r, None) for r in rows if r[1] < 20], key=repr)


@pytest.mark.parametrize("size,block", [(400_000, 4096), (3, 2), (1, 1)])
def test_resampling_of_odd_rows(spark, monkeypatch, size, block):
    monkeypatch.setattr(resampling, "BLOCK", block)
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choice(["The", "cat", "naïve", "x1", "Zoë", "a-b", "日本", "ÀB"]) for _ in range(n))
    docs = [(k, some(rng.choice([0, 5, 19, 20, 21, 40]))) for k in range(150)]
    docs += [docs[7]] * 120 + [(5, some(30))] * 2 + [(None, some(25)), (None, None), (900, None), (901, ""), (902, "!?\n"), (903, some(40_000))]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, score int, rank int").repartition(5)
    target = ["the cat", None, "", "naïve naïve"]
    targets = spark.createDataFrame([(t,) for t in target], "text string")
    read = lambda f: sorted((tuple(r) for r in f.collect()), key=repr)
    got = resampling.resample(frame, targets, size=size)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert read(got) == resampled_by_hand(docs, target)
    if size > 3:
        assert read(resampling.resample(frame, targets.limit(0))) == resampled_by_hand(docs, [])
        assert resampling.resample(frame.limit(0), targets).count() == 0


def test_tournament_merges_runs():
    rng = random.Random(3)
    for runs in (1, 2, 5, 33):
        rows = [sorted((rng.randrange(50), rng.randrange(3)) for _ in range(rng.randrange(40))) for _ in range(runs)]
        blocks = sorted(b for r in rows for b in (r[a : a + 4] for a in range(0, len(r), 4)))
        merge, every = resampling.Merge(iter(blocks)), sorted(itertools.chain(*rows))
        first = [merge.next() for _ in range(len(every) // 2)]
        assert first == every[: len(first)]
        assert sorted(merge.rest()) == every[len(first) :]


def test_features_of_several_words():
    words, at = resampling.features("One two  THREE", ngram=2, of=1 << 40)
    assert words == 3 and at.tolist() == [zlib.crc32(x) for x in (b"one", b"two", b"three", b"one two", b"two three")]


# passages


def removed_by_hand(docs, window):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    seen = collections.Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (key, _), w in zip(docs, split, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((key, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_passages_of_odd_texts(spark):
    rng = random.Random(11)
    some = lambda n, of=5000: [f"w{rng.randrange(of)}" for _ in range(n)]
    passage, docs = some(200), []
    for k in range(80):
        n = rng.choice([0, 11, 34, 35, 36, 50, 120, 200])
        at = rng.randrange(201 - n)
        docs.append((k, rng.choice([" ", "\n", " \t "]).join(some(rng.randrange(60)) + passage[at : at + n] + some(rng.randrange(60)))))
    # one passage in very many places, each with one word changed, so kinds of one anchor differ everywhere
    for k in range(80, 140):
        copy = list(passage[:90])
        copy[rng.randrange(90)] = f"odd{k}"
        docs.append((k, " ".join(copy)))
    docs += [(140, "la " * 300), (141, " ".join(some(30) * 3)), (142, None), (143, ""), (144, " \n"), (145, " ".join(some(30_000, 1 << 30) + passage[:40])), (None, " ".join(passage))]
    docs += [docs[3], docs[3], (146, "x" * 200_000), (147, "Ünï " * 40), (147, "ünï " * 34)]
    frame = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, n_words int")
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(frame).collect()), key=repr)
    assert got == removed_by_hand(docs, 35)
    assert substring_dedup.remove_repeats(frame.limit(0)).count() == 0


def test_other_columns_stay(spark):
    frame = spark.createDataFrame([(1, "a b", {"x": 1}, 2, 3)], "doc_id long, text string, m map<string,int>, k1 int, row int")
    got = substring_dedup.remove_repeats(frame)
    assert got.columns == ["doc_id", "m", "k1", "row", *substring_dedup.OUT]
    assert got.first()[:4] == (1, {"x": 1}, 2, 3)
