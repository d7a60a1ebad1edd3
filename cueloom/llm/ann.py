"""Nearest neighbours by hierarchical navigable small-world graphs, one a shard.

Equal vectors are collapsed to one with its smallest ids, so large groups of copies do not spoil a graph or
a task. Distinct vectors are dealt to shards by their length, in rings within a factor of ``RING``, and a ring
of many in parts of at most about ``SHARD`` by a hash. Within a shard one more coordinate makes all vectors equally
long, so that the largest inner product is the smallest angle there, whatever the lengths were.

Each shard's graph is built by insertion: every node searches the graph of those before it, layer by layer, and
is linked with the diverse of the nodes found, in both directions. Nodes enter in
rounds, never more than the graph has already, and the nodes of a round also see each other. The graph is stored as flat
arrays: for every layer one row of neighbours a node.

Queries are packed in blocks. A block meets every shard (a stated query set against all rows: the work is
queries times shards, each a walk of bounded breadth); the blocks of a shard come in groups of ``TOGETHER``, each of which opens
the graph once, and the shards' results are merged.

Defined results: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; very large and very small components are scaled within a shard, scores are those
of the vectors as given; equal scores go to the smaller id; rows with a null id take no part;
repeated rows (one id, one vector) count once; with fewer than k candidates all are found; an empty table gives an
empty result; columns other than the two named are not looked at, whatever their names.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage

SHARD = 8192
#: Greatest ratio of lengths within a shard.
RING = 1.25
#: Neighbours of a node, twice as many in the lowest layer; breadth of the search while building.
M = 16
EF_BUILD = 96
#: Breadth of the search, and nodes that a step of a walk opens.
EF = 200
STEP = 4
#: Nodes that enter together, queries a block, blocks of a shard in a task.
ROUND = 512
QUERIES = 512
TOGETHER = 64


@dataclass
class Graph:
    vectors: np.ndarray
    #: For each layer from the lowest: a row of neighbours for every node (-1: none).
    neighbours: list[np.ndarray]
    level: np.ndarray
    entry: int


def _walk(vectors: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ef nodes nearest to each query by walks from entry (-1: none), best first, and their scores."""
    q, n = len(queries), len(vectors)
    seen = np.zeros((q, n + 1), bool)
    ids = np.full((q, ef), -1, np.int32)
    score = np.full((q, ef), -np.inf, np.float32)
    done = np.ones((q, ef), bool)
    k = entry.shape[1]
    ids[:, :k] = entry
    score[:, :k] = np.where(entry >= 0, np.matmul(vectors[entry], queries[:, :, None])[:, :, 0], -np.inf)
    done[:, :k] = entry < 0
    np.put_along_axis(seen, np.where(entry >= 0, entry, n), True, axis=1)
    live = np.arange(q)
    step = min(STEP, ef)
    while len(live):
        open_ = np.where(done[live], -np.inf, score[live])
        best = np.argpartition(-open_, step - 1, axis=1)[:, :step]
        some = np.take_along_axis(open_, best, axis=1) > -np.inf
        going = some.any(axis=1)
        live, best, some = live[going], best[going], some[going]
        if not len(live):
            break
        node = np.where(some, ids[live[:, None], best], -1)
        done[live[:, None], best] = True
        near = np.where(some[:, :, None], neighbours[node], -1).reshape(len(live), -1)
        near = np.where((near < 0) | seen[live[:, None], near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[live[:, None], near] = True
        new = near < n
        width = int(new.sum(axis=1).max())
        near = np.take_along_axis(near, np.argsort(~new, axis=1, kind="stable")[:, :width], axis=1)
        new = near < n
        s = np.matmul(vectors[np.where(new, near, 0)], queries[live][:, :, None])[:, :, 0]
        all_ids = np.concatenate([ids[live], np.where(new, near, -1)], axis=1)
        all_score = np.concatenate([score[live], np.where(new, s, -np.inf)], axis=1)
        all_done = np.concatenate([done[live], ~new], axis=1)
        order = np.argpartition(-all_score, ef - 1, axis=1)[:, :ef]
        ids[live] = np.take_along_axis(all_ids, order, axis=1)
        score[live] = np.take_along_axis(all_score, order, axis=1)
        done[live] = np.take_along_axis(all_done, order, axis=1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(score, order, axis=1)


def _diverse(vectors: np.ndarray, near: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
    """Of each row of nodes, best first (-1: none), at most `most` that are nearer to the row's own
    vector than to one already taken; room left goes to the best of the others."""
    r, k = near.shape
    own = vectors[near]
    taken = np.zeros((r, k), bool)
    worst = np.full((r, k), -np.inf, np.float32)
    count = np.zeros(r, np.int64)
    for j in range(k):
        take = (near[:, j] >= 0) & (score[:, j] > worst[:, j]) & (count < most)
        taken[:, j] = take
        count += take
        rows = np.flatnonzero(take)
        if j + 1 < k and len(rows):
            to = np.matmul(own[rows, j + 1 :], own[rows, j][:, :, None])[:, :, 0]
            worst[rows, j + 1 :] = np.maximum(worst[rows, j + 1 :], to)
    rank = np.where(taken, 0, np.where(near >= 0, 1, 2)) * k + np.arange(k)
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.take_along_axis(near, order, axis=1)
    if k < most:
        out = np.concatenate([out, np.full((r, most - k), -1, out.dtype)], axis=1)
    return out.astype(np.int32)


def _link(vectors: np.ndarray, neighbours: np.ndarray, new: np.ndarray, near: np.ndarray, score: np.ndarray) -> None:
    """Gives the new nodes their neighbours, and those the new nodes."""
    most = neighbours.shape[1]
    chosen = _diverse(vectors, near, score, min(M, most))
    neighbours[new, : chosen.shape[1]] = chosen
    src, at = np.nonzero(chosen >= 0)
    to, back = chosen[src, at], new[src]
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    nodes, begin = np.unique(to, return_index=True)
    ends = np.append(begin[1:], len(to))
    room = int((ends - begin).max(initial=0))
    more = np.full((len(nodes), room), -1, np.int32)
    row = np.repeat(np.arange(len(nodes)), ends - begin)
    more[row, np.arange(len(to)) - begin[row]] = back
    both = np.concatenate([neighbours[nodes], more], axis=1)
    both.sort(axis=1)
    both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
    s = np.where(both >= 0, np.matmul(vectors[both], vectors[nodes][:, :, None])[:, :, 0], -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")
    both, s = np.take_along_axis(both, order, axis=1), np.take_along_axis(s, order, axis=1)
    full = (both >= 0).sum(axis=1) > most
    kept = both[:, :most].copy()
    if full.any():
        kept[full] = _diverse(vectors, both[full], s[full], most)
    neighbours[nodes, : kept.shape[1]] = kept


def build(vectors: np.ndarray, seed: int = 1) -> Graph:
    """vectors: float32, all of one length."""
    n = len(vectors)
    level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
    layers = int(level.max(initial=0)) + 1
    neighbours = [np.full((n, 2 * M if k == 0 else M), -1, np.int32) for k in range(layers)]
    entry, top = 0, int(level[0]) if n else 0
    a = 1
    while a < n:
        new = np.arange(a, min(n, 2 * a, a + ROUND))
        found = np.full((len(new), 1), entry, np.int32)
        for layer in range(max(top, int(level[new].max())), -1, -1):
            here = level[new] >= layer
            if layer <= top:
                found, _ = _walk(vectors[:a], neighbours[layer][:a], vectors[new], found, EF_BUILD if here.any() else STEP)
            if here.any():
                own = new[here]
                known = found[here] if layer <= top else np.full((len(own), 0), -1, np.int32)
                known = np.where((known >= 0) & (level[known] >= layer), known, -1)
                each = vectors[own] @ vectors[own].T
                np.fill_diagonal(each, -np.inf)
                some = min(M, len(own) - 1)
                beside = np.argpartition(-each, some - 1, axis=1)[:, :some] if some else np.zeros((len(own), 0), int)
                near = np.concatenate([known, own[beside].astype(np.int32)], axis=1)
                s = np.where(near >= 0, np.matmul(vectors[near], vectors[own][:, :, None])[:, :, 0], -np.inf)
                order = np.argsort(-s, axis=1, kind="stable")
                if near.shape[1]:
                    _link(vectors, neighbours[layer], own, np.take_along_axis(near, order, axis=1), np.take_along_axis(s, order, axis=1))
        if level[new].max() > top:
            entry, top = int(new[level[new].argmax()]), int(level[new].max())
        a = int(new[-1]) + 1
    return Graph(vectors, neighbours, level, entry)


def search(graph: Graph, queries: np.ndarray, ef: int = EF) -> tuple[np.ndarray, np.ndarray]:
    """Up to ef nodes of each query by inner product, best first (-1: none), and their scores."""
    found = np.full((len(queries), 1), graph.entry if len(graph.vectors) else -1, np.int32)
    for layer in range(int(graph.level[graph.entry]) if len(graph.vectors) else 0, 0, -1):
        found, _ = _walk(graph.vectors, graph.neighbours[layer], queries, found, 2 * STEP)
    return _walk(graph.vectors, graph.neighbours[0], queries, found, ef)


def level_off(vectors: np.ndarray) -> np.ndarray:
    """vectors, scaled, with one more coordinate that makes all of them one long: float32."""
    lengths = _lengths(vectors)
    scale = lengths.max(initial=0.0) or 1.0
    more = np.sqrt(np.maximum(0.0, 1.0 - (lengths / scale) ** 2))
    return np.concatenate([vectors / scale, more[:, None]], axis=1).astype(np.float32)


def _lengths(vectors: np.ndarray) -> np.ndarray:
    most = np.abs(vectors).max(axis=1, initial=0.0)
    most[most == 0] = 1.0
    return most * np.sqrt(((vectors / most[:, None]) ** 2).sum(axis=1))


def _valid(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)


def _ring(vector: Column) -> Column:
    """Number of the ring of a vector by its length, found without overflow."""
    most = F.array_max(F.transform(vector, lambda x: F.abs(x.cast("double"))))
    squares = lambda m: F.aggregate(vector, F.lit(0.0), lambda a, x: a + (x.cast("double") / m) * (x.cast("double") / m))
    return F.floor((F.log(most) + F.log(squares(most)) / 2) / math.log(RING)).cast("int")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def nearest(rows: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD, ef: int = EF) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest rows found of each query, its own row left out."""
    spark = rows.sparkSession
    v = F.col(f"`{vector}`")
    good = rows.filter(_valid(F.coalesce(v, F.array().cast(rows.schema[vector].dataType))) & F.col(f"`{key}`").isNotNull())
    good = good.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v"), is_query.alias("asks"), F.size(v).alias("dim"))
    width = good.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    if width is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.filter(F.col("dim") == width["dim"]).drop("dim")

    # of equal vectors, the k + 1 smallest ids are all that any result can hold; by salted rounds, as one vector may be very common
    def least(frame: DataFrame, *by: str) -> DataFrame:
        return frame.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).filter(F.col("__n") <= k + 1).drop("__n")

    some = least(good.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).distinct(), "v", "salt")
    copies = least(some.drop("salt"), "v").groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    distinct = cut_lineage(copies.withColumn("ring", _ring(F.col("v"))))

    # rings are a few thousand at most, for any numbers that a double can hold
    sizes = sorted((r["ring"], r["count"]) for r in distinct.groupBy("ring").count().collect())
    parts = [(ring, -(-n // shard)) for ring, n in sizes]
    first, shards = [], 0
    for ring, n in parts:
        first.append((ring, shards, n))
        shards += n
    places = F.broadcast(spark.createDataFrame(first, "ring int, first int, parts int"))
    dealt = distinct.join(places, "ring").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("v"), F.col("parts"))).cast("int")).select("shard", "v", "ids")

    def index(key_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.str[0])
        exact = _matrix(pdf["v"])
        graph = build(level_off(exact))
        counts = pdf["ids"].map(len).to_numpy(np.int64)
        stored = {"exact": exact, "level": graph.level, "neighbours": graph.neighbours, "entry": graph.entry, "ids": np.concatenate(pdf["ids"].to_list()).astype(np.int64), "at": np.concatenate([[0], np.cumsum(counts)])}
        return pd.DataFrame({"shard": [key_[0]], "graph": [pickle.dumps(stored, protocol=5)]})

    graphs = cut_lineage(dealt.repartition(shards, "shard").groupBy("shard").applyInPandas(index, "shard int, graph binary"))

    queries = good.filter("asks").select("id", "v").distinct()
    n_blocks = max(1, -(-queries.count() // QUERIES))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), QUERIES):
                part = batch.iloc[a : a + QUERIES]
                yield pd.DataFrame({"block": [pickle.dumps((part["id"].to_numpy(np.int64), _matrix(part["v"])), protocol=5)]})

    # the blocks of a shard in groups, to each of which the graph goes once
    groups = -(-n_blocks // TOGETHER)
    packed = queries.repartition(n_blocks).mapInPandas(pack, "block binary")
    blocks = packed.select("block", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    spread = graphs.select("shard", "graph", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))

    def ask(_: tuple, graph_rows: pd.DataFrame, block_rows: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})]
        if len(graph_rows):
            stored = pickle.loads(graph_rows["graph"].iloc[0])
            graph = Graph(level_off(stored["exact"]), stored["neighbours"], stored["level"], stored["entry"])
            for raw in block_rows["block"]:
                ids, vectors = pickle.loads(raw)
                flat = np.concatenate([vectors / _lengths(vectors)[:, None], np.zeros((len(vectors), 1))], axis=1).astype(np.float32)
                found.append(_expanded(stored, ids, vectors, search(graph, flat, ef)[0], k))
        return pd.concat(found, ignore_index=True)

    asked = spread.groupBy("shard", "part").cogroup(blocks.groupBy("shard", "part"))
    hits = asked.applyInPandas(ask, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _expanded(stored: dict, ids: np.ndarray, vectors: np.ndarray, found: np.ndarray, k: int) -> pd.DataFrame:
    """The k best ids of each query, copies of found vectors included, by exact scores."""
    ok = found >= 0
    q, node = np.nonzero(ok)[0], found[ok]
    score = np.einsum("pd,pd->p", stored["exact"][node], vectors[q])
    n = np.diff(stored["at"])[node]
    ends = np.cumsum(n)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(stored["at"][:-1][node] - (ends - n), n)
    q, score, vec = np.repeat(q, n), np.repeat(score, n), stored["ids"][at]
    other = vec != ids[q]
    q, score, vec = q[other], score[other], vec[other]
    order = np.lexsort((vec, -score, q))
    q, score, vec = q[order], score[order], vec[order]
    rank = np.arange(len(q)) - np.searchsorted(q, np.arange(len(ids)))[q]
    best = rank < k
    return pd.DataFrame({"query_id": ids[q[best]], "vec_id": vec[best], "score": score[best]})
