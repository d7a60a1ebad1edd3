"""Product codes of vectors, with exact integer arithmetic.

Components become integers, floor(``SCALE`` * x), and vectors are cut into ``PARTS`` equal parts. Each part position has a codebook of up to
``ENTRIES`` entries, which starts as that part of the first vectors by id. Each of ``ROUNDS`` rounds assigns every part to its nearest
entry and replaces each entry by the floored mean of its parts.

The nearest entry is found by exponion search. A part starts at the entry that it had before, at squared distance U. By the
triangle inequality the nearest entry is at most twice as far from that entry as the part is, so among the other entries, listed by their
squared distance from it, only those up to 4 * U are looked at. Everything is an integer: no root and no rounding decides
what is looked at, ties included, and of equally near entries the one of the least index is taken.

Assigned parts are summed by entry within each partition; what is shuffled and what reaches the driver are sums of
PARTS x ENTRIES entries, whatever the number of vectors. The codebooks, as large, go to the tasks.

Defined results: rows whose vector is null or has null or non-finite components are dropped; vectors of another length than that of the
first vector by id, those whose length is no multiple of PARTS, and those with a component whose integer is beyond ``_most`` keep their row, with null code
and error, and take no part in codebooks; of tied ids the smaller vector comes first, null ids come last; repeated rows are coded each and count
each; with fewer vectors than ENTRIES the codebooks are smaller; an empty table gives an empty result; errors are summed over equal
labels, null being one; further columns are not passed on, so names cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_by_key

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Pairs of parts and entries compared at once.
PAIRS = 200_000


def _most(width: int) -> int:
    """Largest integer component for which a squared distance of a part, with an index behind it, fits a long."""
    return math.isqrt((1 << 62) // (max(width, 1) * ENTRIES)) // 2


class Codebook:
    """The entries of one part position, and of each the list of all by distance from it."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.order = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.order, axis=1)

    def nearest(self, parts: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each part, and the squared distance; before: where each search starts."""
        start = ((parts - self.entries[before]) ** 2).sum(axis=1)
        # entries at most 4 * start away from where the search starts, that one included
        by = np.argsort(before, kind="stable")
        n = np.empty(len(parts), np.int64)
        cuts = np.searchsorted(before[by], np.arange(len(self.entries) + 1))
        for entry, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            n[by[a:b]] = np.searchsorted(self.far[entry], 4 * start[by[a:b]], side="right")
        best = np.empty(len(parts), np.int64)
        ends = np.cumsum(n)
        at = 0
        while at < len(parts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            some = n[at:to]
            first = np.cumsum(some) - some
            row = np.repeat(np.arange(at, to), some)
            entry = self.order[before[row], np.arange(len(row)) - np.repeat(first, some)]
            distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
            best[at:to] = np.minimum.reduceat(distance * ENTRIES + entry, first)
            at = to
        return best % ENTRIES, best // ENTRIES


def assign(vectors: np.ndarray, codebooks: list[Codebook], before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and squared distance of each part of some integer vectors."""
    parts = vectors.reshape(len(vectors), PARTS, -1)
    found = [c.nearest(np.ascontiguousarray(parts[:, p]), before[:, p]) for p, c in enumerate(codebooks)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _matrix(column: pa.Array, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _assigned(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """rows (row, v, code) with the code by these entries, and error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        for batch in batches:
            if batch.num_rows:
                code, distance = assign(_matrix(batch.column(1), np.int64), books, _matrix(batch.column(2), np.int64))
                offsets = pa.array(np.arange(0, PARTS * (len(code) + 1), PARTS, dtype=np.int32))
                codes = pa.ListArray.from_arrays(offsets, pa.array(code.astype(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes, pa.array(distance.sum(axis=1))], names=["row", "v", "code", "error"])

    return rows.select("row", "v", "code").mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, v array<long>, code array<int>, error long")


def _replaced(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """entries, each replaced by the floored mean of the parts that have its code."""
    shape = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((shape[0] * shape[1], shape[2]), np.int64), np.zeros(shape[0] * shape[1], np.int64)
        most = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column(0), np.int64)
            # sums are handed on before they could grow out of a long
            most += len(vectors) * int(np.abs(vectors).max(initial=0))
            if most >> 62:
                yield _sums(sums, counts)
                sums[:], counts[:], most = 0, 0, len(vectors) * int(np.abs(vectors).max(initial=0))
            at = (_matrix(batch.column(1), np.int64) + np.arange(PARTS) * shape[1]).ravel()
            np.add.at(sums, at, vectors.reshape(-1, shape[2]))
            counts += np.bincount(at, minlength=len(counts))
        yield _sums(sums, counts)

    each = rows.select("v", "code").mapInArrow(run, "at int, place int, total long, n long")
    out = entries.copy().reshape(-1, shape[2])
    # one row a component of an entry
    for r in each.groupBy("at", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        out[r["at"], r["place"]] = int(r["total"]) // r["n"]
    return out.reshape(shape)


def _sums(sums: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    at = np.flatnonzero(counts)
    width = sums.shape[1]
    columns = [np.repeat(at, width).astype(np.int32), np.tile(np.arange(width, dtype=np.int32), len(at)), sums[at].ravel(), np.repeat(counts[at], width)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["at", "place", "total", "n"])


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, code (hex), error, label_error and codebooks_sha256 of each vector."""
    spark = rows.sparkSession
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = rows.filter(v.isNotNull() & ~bad).select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.transform(v, lambda x: x.cast("double")).alias("x"))
    order = [F.col("key").isNull(), "key", "x"]
    first = good.orderBy(*order).first()
    if first is None:
        return spark.createDataFrame([], f"{key} {rows.schema[key].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    width = len(first["x"])
    most = _most(width // PARTS)
    fits = (F.size("x") == width) & F.lit(width % PARTS == 0 and width > 0) & ~F.exists("x", lambda x: F.abs(x) * SCALE > most - 1)
    v = F.when(fits, F.transform("x", lambda x: F.floor(x * SCALE).cast("long")))
    coded = cut_lineage(good.select(F.struct("key", "label").alias("row"), v.alias("v"), F.col("x").alias("x")))
    heads = coded.filter("v is not null").orderBy(F.col("row.key").isNull(), "row.key", "x").limit(ENTRIES).select("v").collect()
    start = np.array([r["v"] for r in heads], np.int64).reshape(len(heads), PARTS, -1) if heads else np.zeros((0, PARTS, 1), np.int64)
    entries = np.ascontiguousarray(start.transpose(1, 0, 2))
    now = coded.filter("v is not null").select("row", "v", F.array_repeat(F.lit(0), PARTS).alias("code"))
    if heads:
        for _ in range(ROUNDS):
            now = cut_lineage(_assigned(now, entries))
            entries = _replaced(now, entries)
        now = _assigned(now, entries)
    else:
        now = now.withColumn("error", F.lit(None).cast("long"))
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()

    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c.cast("long")), 2, "0")), ""))
    done = now.select("row", code.alias("code"), "error").union(coded.filter("v is null").select("row", F.lit(None).cast("string"), F.lit(None).cast("long")))
    named = cut_lineage(done.select("row.key", F.col("row.label").isNull().alias("none"), F.coalesce(F.col("row.label").cast("string"), F.lit("")).alias("of"), "code", "error"))
    sums = cut_lineage(named.groupBy("none", "of").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    out = join_by_key(named, sums, ["none", "of"], sums.agg(F.sum("n")).first()[0] or 0)
    return out.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The same rows in SQL: every part against every entry."""
    assigned = lambda books: f"""
        SELECT vec_id, part, any_value(v) AS v, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
            SELECT p.vec_id, p.part, p.v, b.entry, list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - b.v[i]) * (p.v[i] - b.v[i])))::BIGINT AS d
            FROM parts p JOIN {books} b USING (part)) GROUP BY vec_id, part"""  # noqa: E731
    sql = f"""
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    parts AS (SELECT vec_id, part, v[part * len(v) // {parts} + 1 : (part + 1) * len(v) // {parts}] AS v FROM kept, range({parts}) t(part)),
    books0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v FROM parts QUALIFY entry < {entries}),"""
    for k in range(rounds):
        sql += f"""
    assigned{k} AS ({assigned(f"books{k}")}),
    means{k} AS (
        SELECT part, entry, list(m ORDER BY i) AS v FROM (
            SELECT part, entry, i, floor(sum(v[i])::DOUBLE / count(*))::BIGINT AS m FROM assigned{k}, (SELECT unnest(range(1, (SELECT max(len(v)) FROM parts) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
    books{k + 1} AS (SELECT b.part, b.entry, coalesce(m.v, b.v) AS v FROM books{k} b LEFT JOIN means{k} m USING (part, entry)),"""
    return sql + f"""
    final AS ({assigned(f"books{rounds}")}),
    coded AS (SELECT vec_id, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM final GROUP BY vec_id)
    SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
        (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) FROM books{rounds}) AS codebooks_sha256
    FROM coded JOIN kept USING (vec_id)"""
