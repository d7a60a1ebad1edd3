"""Importance resampling towards a target distribution of hashed word features.

Every document has a weight, the mean of its features' gains: how much more frequent a feature's
bucket is in the target texts than in the documents. Gains stand in one array of ``BUCKETS`` numbers, so a document's
weight is one lookup of its features' buckets. A Gumbel number from a hash of the document's key is added, which makes
the highest scores a sample without replacement in proportion to the exponential of the weights.

The draw is exact and is made by merging sorted runs:

* Scores are integers of a narrow range, so counts of documents by score are a small table. It gives the number to
  draw, the least score that a drawn document can have, and score ranges of about ``RANGE`` rows. A score that has more
  rows than that is cut again by quantiles of the key.
* Each partition sorts its eligible rows that are not below the least score into a run, in which equal rows are one
  row with a count, and cuts the run at the borders of ranges and into blocks of ``BLOCK`` rows at most.
* A range is merged by one task. Its blocks come in the order of their first rows, from Spark's sorted shuffle, which
  spills to disk; a tournament tree of the runs' heads emits rows and takes in a block when the order has come to its
  first row. So one block of a run is in memory at a time, however long the runs are.
* Each range knows how many rows stand before it, so ranks are emitted at once, and a merge ends when the last
  row of the draw has its rank. What stands beyond is passed on without rank and without merging.

Defined results: a null text, or one without words, has no features, weight 0 and is not eligible; a very long text counts as any
other, whole; of tied scores the smaller key comes first, a null key last, and rows equal in key and score by features and weight;
repeated rows have as many ranks as there are of them; an empty table gives an empty result, and without target texts all
features get the gains of an empty target; the result has the key and four columns, so further columns cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Most words of a feature.
NGRAM = 1
#: Rows that a task merges, about, and the most rows of a block.
RANGE, BLOCK = 400_000, 4096
#: Upper case to lower case, and every byte that is in no word to a space. Bytes from 0x80 on are parts of letters.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str | None, ngram: int = NGRAM, of: int = BUCKETS) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each feature: all runs of 1 to ngram words, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS).split()
    hashes = list(map(zlib.crc32, words))
    for n in range(2, ngram + 1):
        hashes += [zlib.crc32(b" ".join(x)) for x in zip(*(words[k:] for k in range(n)), strict=False)]
    return len(words), np.array(hashes, np.int64) % of


def bucket_counts(texts: DataFrame, text: str = "text", ngram: int = NGRAM, of: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket has. Counted within a partition, then across; the driver gets one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(of, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(features(x.as_py(), ngram, of)[1], minlength=of)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    found = texts.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(of, np.int64)
    for r in found:
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed odds) of each bucket."""
    of, s, t = len(own), int(own.sum()), int(target.sum())
    odds = (target + 1.0) * (s + of) / ((own + 1.0) * (t + of))
    return np.array([math.floor(1000 * math.log(x)) for x in odds.tolist()], np.int64)


def gumbel(key: object, seed: str = SEED) -> int:
    """floor(1000 * a Gumbel number) from a hash of the key; null counts as no text."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, text: str = "text", key: str = "doc_id", seed: str = SEED, least: int = LEAST_WORDS, ngram: int = NGRAM) -> DataFrame:
    """key, n_features, weight, score and eligible (whether the text has the least number of words)."""
    of = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = batch.column(0).to_pylist(), []
            for k, x in zip(keys, batch.column(1), strict=True):
                words, at = features(x.as_py(), ngram, of)
                weight = int(gain[at].sum()) // len(at) if len(at) else 0
                rows.append((len(at), weight, weight + gumbel(k, seed), words >= least))
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate([pa.int64(), pa.int64(), pa.int64(), pa.bool_()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", "n_features", "weight", "score", "eligible"])

    narrow = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    return narrow.mapInArrow(run, "key long, n_features long, weight long, score long, eligible boolean")


#: A row in the order of the draw: what is compared, ascending. Scores are negated, a null key is (1, 0).
ROW = ["down", "none", "id", "n_features", "weight"]
BLOCKS = ", ".join(["range int", "run int", *(f"first_{c} long" for c in ROW[:3]), *(f"{c} array<long>" for c in ROW), "n array<long>", "rows long"])


def _cut(borders: list[tuple[int, int, int]]):
    """Runs of a partition's sorted rows, as blocks."""
    edges = np.array(borders, np.int64).reshape(-1, 3)

    def ranges(rows: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(rows), np.int64), np.full(len(rows), len(edges), np.int64)
        while (open_ := low < high).any():
            mid = (low + high) // 2
            at = edges[np.minimum(mid, len(edges) - 1)]
            a, b, c = ((rows[:, i] > at[:, i]).astype(int) - (rows[:, i] < at[:, i]) for i in range(3))
            beyond = 4 * a + 2 * b + c >= 0  # the row is at the border or beyond
            low, high = np.where(open_ & beyond, mid + 1, low), np.where(open_ & ~beyond, mid, high)
        return low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        held = np.zeros((0, len(ROW) + 1), np.int64)
        for batch in batches:
            new = np.stack([c.to_numpy() for c in batch.columns] + [np.ones(batch.num_rows, np.int64)], axis=1)
            held = _summed(np.concatenate([held, new]))
            if len(held) > BLOCK:
                yield from _blocks(held[:-1], ranges(held[:-1]), number)
                held = held[-1:]
        if len(held):
            yield from _blocks(held, ranges(held), number)

    return run


def _summed(rows: np.ndarray) -> np.ndarray:
    """Sorted rows, the last column a count; equal rows become one."""
    new = np.append(True, (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1))[: len(rows)]
    begin = np.flatnonzero(new)
    out = rows[begin].copy()
    out[:, -1] = np.add.reduceat(rows[:, -1], begin) if len(begin) else 0
    return out


def _blocks(rows: np.ndarray, ranges: np.ndarray, number: int) -> Iterator[pa.RecordBatch]:
    at = np.unique(np.concatenate([np.arange(0, len(rows), BLOCK), np.flatnonzero(np.append(True, ranges[1:] != ranges[:-1]))]))
    offsets = pa.array(np.append(at, len(rows)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(rows[:, i])) for i in range(rows.shape[1])]
    firsts = [pa.array(rows[at, i]) for i in range(3)]
    count = np.add.reduceat(rows[:, -1], at)
    yield pa.RecordBatch.from_arrays([pa.array(ranges[at].astype(np.int32)), pa.array(np.full(len(at), number, np.int32)), *firsts, *lists, pa.array(count)], names=[c.split(" ")[0] for c in BLOCKS.split(", ")])


class Tournament:
    """The least head of several sorted runs. Leaves are the runs' heads; each inner node holds the winner of its two children,
    so replacing a head replays one path. An exhausted leaf is free for another run."""

    def __init__(self) -> None:
        self.size = 1
        self.heads: list[tuple | None] = [None]
        self.tree: list[int] = [0, 0]
        self.free = [0]

    def _wins(self, a: int, b: int) -> int:
        x, y = self.heads[a], self.heads[b]
        return a if y is None or (x is not None and x <= y) else b

    def _replay(self, leaf: int) -> None:
        node = (self.size + leaf) >> 1
        while node:
            left, right = 2 * node, 2 * node + 1
            child = lambda c: c - self.size if c >= self.size else self.tree[c]
            self.tree[node] = self._wins(child(left), child(right)) if self.size > 1 else 0
            node >>= 1

    def add(self, head: tuple) -> int:
        """The leaf that the run got."""
        if not self.free:
            self.free = list(range(2 * self.size - 1, self.size - 1, -1))
            self.heads += [None] * self.size
            self.size *= 2
            self.tree = [0] * self.size
            for node in range(self.size - 1, 0, -1):
                left, right = (c - self.size if c >= self.size else self.tree[c] for c in (2 * node, 2 * node + 1))
                self.tree[node] = self._wins(left, right)
        leaf = self.free.pop()
        self.replace(leaf, head)
        return leaf

    def replace(self, leaf: int, head: tuple | None) -> None:
        self.heads[leaf] = head
        if head is None:
            self.free.append(leaf)
        self._replay(leaf)

    def best(self) -> tuple[int, tuple | None]:
        leaf = self.tree[1] if self.size > 1 else 0
        return leaf, self.heads[leaf]


class Merge:
    """Rows of sorted blocks in order, one by one; the blocks come in the order of their first rows."""

    def __init__(self, blocks: Iterator[list[tuple]]) -> None:
        self.tree, self.open, self.blocks = Tournament(), {}, blocks
        self.ahead = next(blocks, None)

    def next(self) -> tuple | None:
        leaf, head = self.tree.best()
        while self.ahead is not None and (head is None or self.ahead[0] < head):
            rows = iter(self.ahead)
            self.open[self.tree.add(next(rows))] = rows
            self.ahead = next(self.blocks, None)
            leaf, head = self.tree.best()
        if head is not None:
            self.tree.replace(leaf, next(self.open[leaf], None))
        return head

    def rest(self) -> Iterator[tuple]:
        """All that is left, in no order."""
        yield from (h for h in self.tree.heads if h is not None)
        for leaf, head in enumerate(self.tree.heads):
            yield from self.open[leaf] if head is not None else ()
        yield from self.ahead or ()
        for block in self.blocks:
            yield from block


def _merge(before: dict[int, int], draw: int):
    """Ranked rows of whole ranges; the input is sorted by range and first row of a block."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for i in range(batch.num_rows):
                rows = zip(*(columns[c][i].values.to_pylist() for c in [*ROW, "n"]), strict=True)
                yield columns["range"][i].as_py(), list(rows)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for number, group in itertools.groupby(blocks(batches), key=lambda x: x[0]):
            merge, rank = Merge(block for _, block in group), before[number]
            while rank < draw and (row := merge.next()):
                for _ in range(row[-1]):
                    rank += 1
                    yield *row[:-1], rank if rank <= draw else None
            # beyond the draw nothing is merged
            for row in merge.rest():
                yield from itertools.repeat((*row[:-1], None), row[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ranked(batches)
        while some := list(itertools.islice(rows, 50_000)):
            down, none, key, n, weight, rank = zip(*some, strict=True)
            keys = [None if x else k for x, k in zip(none, key, strict=True)]
            columns = [pa.array(c, pa.int64()) for c in (keys, n, weight, [-d for d in down], rank)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "n_features", "weight", "score", "rank"])

    return run


def _borders(rows: DataFrame, counts: list[tuple[int, int]], size: int) -> list[tuple[int, int, int]]:
    """First rows of all ranges but the first. counts: scores, highest first, with their rows."""
    hot = {score: -(-n // size) for score, n in counts if n > size}
    cuts: dict[int, list[int]] = {}
    if hot:
        most = max(hot.values())
        some = rows.filter(F.col("score").isin(list(hot)) & F.col("key").isNotNull())
        at = some.groupBy("score").agg(F.percentile_approx("key", [k / most for k in range(1, most)]).alias("at"))
        cuts = {r.score: sorted(set(r["at"])) for r in at.collect()}
    out, held = [], 0
    for score, n in counts:
        if held and held + n > size:
            out.append((-score, 0, -(1 << 63)))
            held = 0
        out += [(-score, 0, x) for x in cuts.get(score, [])]
        held += n
    return out


def resample(
    docs: DataFrame, target: DataFrame, text: str = "text", key: str = "doc_id", target_text: str = "text", percent: int = PERCENT, seed: str = SEED, least: int = LEAST_WORDS, ngram: int = NGRAM, of: int = BUCKETS, size: int = RANGE
) -> DataFrame:
    """key, n_features, weight, score and rank (null: not drawn) of every row of docs; percent of those with the least number of words are drawn."""
    gain = gains(bucket_counts(docs, text, ngram, of), bucket_counts(target, target_text, ngram, of))
    rows = cut_lineage(scored(docs, gain, text, key, seed, least, ngram))

    # one row a score: some 100,000 whole numbers at most, as logarithms of counts are below 50
    counts = sorted(((r.score, r.n) for r in rows.filter("eligible").groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draw = sum(n for _, n in counts) * percent // 100
    drawn = 0
    for i, (_, n) in enumerate(counts):
        if drawn >= draw:
            counts = counts[:i]
            break
        drawn += n
    if not counts:
        return rows.select(F.col("key").alias(key), "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))

    may = F.col("eligible") & (F.col("score") >= counts[-1][0])
    none = F.col("key").isNull()
    order = [(-F.col("score")).alias("down"), none.cast("long").alias("none"), F.coalesce("key", F.lit(0)).cast("long").alias("id"), "n_features", "weight"]
    runs = rows.filter(may).select(*order).sortWithinPartitions(*ROW)
    blocks = cut_lineage(runs.mapInArrow(_cut(_borders(rows.filter(may), counts, size)), BLOCKS))
    sizes = sorted((r.range, r.n) for r in blocks.groupBy("range").agg(F.sum("rows").alias("n")).collect())
    before = dict(zip([r for r, _ in sizes], itertools.accumulate([0, *(n for _, n in sizes)]), strict=False))

    firsts = [f"first_{c}" for c in ROW[:3]]
    dealt = blocks.repartition(len(sizes), "range").sortWithinPartitions("range", *firsts, *ROW)
    ranked = dealt.mapInArrow(_merge(before, draw), "key long, n_features long, weight long, score long, rank long")
    others = rows.filter(~may).select("key", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.union(others).withColumnRenamed("key", key)


#: The same rows in SQL. CRC-32 is a table of 256 numbers, made bit by bit, and a fold over a word's bytes.
ORACLE_SQL = rf"""
    WITH RECURSIVE bits AS (
        SELECT b AS byte, b::BIGINT AS c, 0 AS step FROM range(256) t(b)
        UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM bits WHERE step < 8),
    crc AS (SELECT list(c ORDER BY byte) AS t FROM bits WHERE step = 8),
    texts AS (
        SELECT row_number() OVER () AS row, doc_id, text, false AS target FROM documents
        UNION ALL SELECT NULL, NULL, text, true FROM benchmark),
    features AS (
        SELECT row, target, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM texts),
    words AS (
        SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(word))) // 2 + 1), lambda i: ('0x' || hex(encode(word))[2 * i - 1 : 2 * i])::BIGINT)),
            lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) % {BUCKETS} AS bucket
        FROM (SELECT DISTINCT word FROM features), crc),
    counts AS (SELECT bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM features JOIN words USING (word) GROUP BY bucket),
    gains AS (
        SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (sum(s) OVER () + {BUCKETS})::DOUBLE / ((s + 1.0::DOUBLE) * (sum(t) OVER () + {BUCKETS})::DOUBLE)))::BIGINT AS gain FROM counts),
    weights AS (
        SELECT row, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN words USING (word) JOIN gains USING (bucket) WHERE NOT target GROUP BY row),
    scored AS (
        SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
        FROM texts LEFT JOIN weights USING (row) WHERE NOT target),
    ranked AS (
        SELECT *, n_features >= {LEAST_WORDS} AS may, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place,
            count(*) FILTER (WHERE n_features >= {LEAST_WORDS}) OVER () * {PERCENT} // 100 AS draw FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= draw THEN place END AS rank FROM ranked"""
