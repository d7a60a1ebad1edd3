import random
import time

import numpy as np
from pyspark.sql import functions as F

from cueloom.llm import language_id, pieces, pii


def test_long_parts_equal_lanes(monkeypatch):
    encoder = pieces.Encoder(pieces.load_pieces())
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnoprstu", k=n)) for n in (257, 300, 1000)] + ["日本語の文章" * 100 + "▁é\U0001f600x" * 20, " " * 400]
    whole = [encoder._long(t).tolist() for t in texts]
    assert whole == [encoder._lane([t])[0].tolist() for t in texts]
    monkeypatch.setattr(pieces, "SPAN", 7)
    assert whole == [encoder._long(t).tolist() for t in texts]
    monkeypatch.undo()
    for t in texts:
        ids, counts = encoder.encode([t])
        assert encoder.decode(ids) == t and counts.tolist() == [len(ids)]
    began = time.perf_counter()
    t = "天地玄黄宇宙洪荒" * 25_000
    ids, _ = encoder.encode([t])
    assert encoder.decode(ids) == t and time.perf_counter() - began < 20


def test_redaction_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = []
    for n in (0, 1, 2, 3, 7, 40):
        rows.append((" ".join(rng.choice(["a@b.co", "1.2.3.4", "word", "é", "x@1.2.3.4.5", "+1 555 123 4567"]) for _ in range(n)),))
    frame = spark.createDataFrame(rows, "text string")
    want = [r[0] for r in frame.select(pii.redact(F.col("text"))).collect()]
    monkeypatch.setattr(pii, "RUN", 2)
    assert [r[0] for r in frame.select(pii.redact(F.col("text"))).collect()] == want
    assert not any("@" in w or "1.2.3.4" in w for w in want)


def test_capitals_of_a_text_that_grows():
    plain = language_id.split_words(["hello world again"]).buckets
    shouted = language_id.split_words(["HELLO WORLD AGAIN İ"]).buckets
    assert np.array_equal(plain, shouted[: len(plain)])
