import collections
import random

from cueloom.llm import suffix_dedup


def windows(docs, n):
    """Words of each document that a run of n words covers which another document has too."""
    seen = collections.defaultdict(set)
    for d, words in docs.items():
        for i in range(len(words) - n + 1):
            seen[tuple(words[i : i + n])].add(d)
    return {d: {j for i in range(len(w) - n + 1) if len(seen[tuple(w[i : i + n])]) > 1 for j in range(i, i + n)} for d, w in docs.items()}


def test_passages_of_51_words_are_found_and_none_below_25(spark):
    rng = random.Random(9)
    some = lambda n: [f"w{rng.randrange(100_000)}" for _ in range(n)]
    passage, docs = some(120), {}
    for i in range(60):
        n = rng.choice([0, 10, 24, 25, 38, 50, 51, 52, 70, 120])
        at = rng.randrange(121 - n)
        docs[i] = some(rng.randrange(90)) + passage[at : at + n] + some(rng.randrange(90))
    docs[60], docs[61], docs[62], docs[63] = ["la"] * 300, [], some(10), some(40_000) + passage[:51]
    docs[64] = some(30) * 3  # repeats within one document only
    rows = [(d, rng.choice([" ", "\n", "  "]).join(w)) for d, w in docs.items()] + [(65, None), (64, " ".join(docs[64]))]
    rows[64] = rows[-1]
    got = {r.doc_id: r.n_shared_words for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    long, short = windows(docs, 51), windows(docs, 25)
    assert got[65] == 0
    for d in docs:
        assert got[d] <= len(short[d])
        assert (got[d] > 0) if long[d] else (got[d] == 0 or short[d])
