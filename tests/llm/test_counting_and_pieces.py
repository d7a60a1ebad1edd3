import math
import random

import pytest

from cueloom.llm import pieces, token_counts
from cueloom.llm.vocabulary import SPACE_MARK, load_pieces

ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "the cat ▁ sat"), (4, "the cat ▁ sat"), (None, "日本語 text\u0000 😀"), (5, "x" * 50_000), (6, "the of and " * 20_000)]


@pytest.fixture(scope="module")
def table():
    return load_pieces()


def greedy(word, vocabulary):
    s, i, n = SPACE_MARK + word, 0, 0
    while i < len(s):
        for j in range(len(s), i, -1):
            if s[i:j] in vocabulary and (i == 0) == (s[i] == SPACE_MARK):
                break
        else:
            return 0
        i, n = j, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(200):
        vocabulary = {SPACE_MARK + "".join(rng.choices("ab", k=rng.randint(0, 3))) for _ in range(4)} | {"".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(4)}
        machine = token_counts.Automaton(vocabulary)
        for _ in range(40):
            word = "".join(rng.choices("abc", k=rng.randint(1, 9)))
            assert machine.length(word) == greedy(word, vocabulary), (vocabulary, word)


def test_counts_of_odd_rows(spark, table):
    rows = spark.createDataFrame([(i, t, 7) for i, t in ODD], "doc_id long, text string, n_words int")
    got = token_counts.count_tokens(rows).collect()
    assert len(got) == len(ODD)
    vocabulary = {p for p, r in zip(table.pieces, table.ranks, strict=True) if r and SPACE_MARK not in p[1:]}
    for (i, t), row in zip(ODD, got, strict=True):
        ws = (t or "").encode().split()
        lengths = [greedy(w.decode(), vocabulary) if len(w) < 100 else None for w in ws]
        assert (row.doc_id, row.n_words) == (i, len(ws))
        if None not in lengths:
            assert row.n_tokens == sum(n or 1 for n in lengths) and row.n_unknown == lengths.count(0)
    assert token_counts.count_tokens(rows.limit(0)).count() == 0


def best_split(part, table):
    score = {p.replace(SPACE_MARK, " "): -round(1000 * math.log(r + 2)) for p, r in zip(table.pieces, table.ranks, strict=True) if r}
    worst = min(score.values()) - 5000
    best = [(0, [])]
    for end in range(1, len(part) + 1):
        c = part[end - 1]
        option = (best[end - 1][0] + worst * len(c.encode()), best[end - 1][1] + [c])
        for k in range(1, min(16, end) + 1):
            s = part[end - k : end]
            if s in score and SPACE_MARK not in s and best[end - k][0] + score[s] >= option[0]:
                option = (best[end - k][0] + score[s], best[end - k][1] + [s])
        best.append(option)
    return best[-1][1]


def test_viterbi_is_the_best_split(table):
    encoder = pieces.Encoder(table)
    for part in [" hello", " antidisestablishment", "  x", "abc", " zzzz日q", " ▁a", "   ", " représentation"]:
        ids, counts = encoder.encode([part[1:] if part[0] == " " else part])
        want = best_split(part if part[0] == " " else " " + part, table)
        decoded = [encoder.raw[i].decode("utf-8", "replace") for i in ids.tolist()]
        if all(len(w) > 1 or w.isascii() for w in want):
            assert decoded == want
        assert encoder.decode(ids) == (part[1:] if part[0] == " " else part)


def test_round_trip_of_odd_rows(spark, table):
    rows = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, ids string")
    encoded = pieces.encode(rows, verify=True)
    assert [r.round_trip for r in encoded.collect()] == [None if t is None else True for _, t in ODD]
    assert [(r.doc_id, r.text) for r in pieces.decode(encoded).collect()] == ODD
    assert pieces.encode(rows.limit(0)).count() == 0


def test_blocks_do_not_change_results(spark, table, monkeypatch):
    encoder = pieces.Encoder(table)
    texts = [t for _, t in ODD if t]
    whole = encoder.encode(texts)[0].tolist()
    monkeypatch.setattr(pieces, "LANE", 50)
    monkeypatch.setattr(pieces, "MEMORY", 3)
    small = pieces.Encoder(table)
    assert small.encode(texts)[0].tolist() == whole
