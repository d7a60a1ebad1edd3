"""SentencePiece encoding and decoding by a batched Viterbi.

Text is prefixed with a space, spaces become the mark, and the result is cut before every run of
marks; no piece goes across such a cut, so the parts can be encoded alone and each distinct part
of a batch once. Parts of equal length advance together: at each end position the hashes of all
substrings that end there are looked up in sorted piece keys (and the characters compared), and
maxima over whole columns store back pointers. A part of more than ``LONG`` characters, as of text without spaces,
is a lane of its own: the substrings of all its positions are looked up together, and the same recurrence
walks over what was found, so its time is in proportion to its length.

A piece's score is that of Zipf's law at its rank in the vocabulary, as an integer, so sums are
exact; of equally good splits the one with the longer last piece counts, at every position.
Characters without a piece, and the mark itself, become bytes, so decoding gives the very text.

Defined results: null encodes to null and decodes to null; the empty text to no pieces; very long texts are
encoded whole, a block each; repeated rows are encoded one by one; an empty table gives an empty result; columns of the input other than the text are passed on unless one
has the name of an output column.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vocabulary import PIECES, SPACE_MARK, PieceTable, load_pieces

#: Characters of text encoded at once, and of equally long parts advanced at once.
BLOCK = 4_000_000
LANE = 400_000
#: Entries of a task's memory of parts; it is emptied when full.
MEMORY = 400_000
#: Characters from which on a part is advanced alone, and positions of it whose matches are held at once.
LONG = 256
SPAN = 65_536
PART = re.compile(r" +[^ ]*|[^ ]+")
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MARK = np.uint32(ord(SPACE_MARK))
_LITERAL_MARK = np.uint32(0x10FFFF + 1)
_NONE = np.int64(-(1 << 60))


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(29))) | np.uint64(1)


class Encoder:
    def __init__(self, table: PieceTable, most: int = MEMORY):
        self.table, self.most = table, most
        ok = [i for i, r in enumerate(table.ranks) if r]
        assert all(SPACE_MARK not in table.pieces[i][1:] or not table.pieces[i].strip(SPACE_MARK) for i in ok)
        self.longest = max(len(table.pieces[i]) for i in ok)
        self.power = np.ones(self.longest + 1, np.uint64)
        for k in range(1, self.longest + 1):
            self.power[k : k + 1] = self.power[k - 1 : k] * _BASE
        self.by_length = {}
        worst = 0
        for n in range(1, self.longest + 1):
            ids = np.array([i for i in ok if len(table.pieces[i]) == n], np.int32)
            if not len(ids):
                continue
            codes = np.array([[ord(c) for c in table.pieces[i]] for i in ids], np.uint32).reshape(-1, n)
            score = np.array([-round(1000 * math.log(table.ranks[i] + 2)) for i in ids], np.int64)
            worst = min(worst, int(score.min()))
            h = np.zeros(len(ids), np.uint64)
            for k in range(n):
                h = h * _BASE + _mixed(codes[:, k])
            order = np.argsort(h)
            self.by_length[n] = (h[order], codes[order], ids[order], score[order])
        self.byte_score = worst - 5000
        self.memory: dict[str, np.ndarray] = {}
        self.raw = [p.replace(SPACE_MARK, " ").encode() for p in table.pieces]
        for b, i in enumerate(table.byte_ids):
            self.raw[i] = bytes([b])
        for i, r in enumerate(table.ranks):
            if not r and i not in set(table.byte_ids):
                self.raw[i] = b""

    def _lane(self, parts: list[str]) -> list[np.ndarray]:
        """Ids of parts of one length; a space stands for the mark."""
        n, size = len(parts[0]), len(parts)
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(size, n).copy()
        codes[codes == _MARK] = _LITERAL_MARK
        codes[codes == 32] = _MARK
        mixed = _mixed(codes)
        prefix = np.zeros((size, n + 1), np.uint64)
        for k in range(n):
            prefix[:, k + 1] = prefix[:, k] * _BASE + mixed[:, k]
        best = np.full((size, n + 1), _NONE, np.int64)
        best[:, 0] = 0
        back = np.zeros((size, n + 1), np.int16)
        piece = np.full((size, n + 1), -1, np.int32)
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        for end in range(1, n + 1):
            # bytes of the last character, always possible
            score = best[:, end - 1] + self.byte_score * width[:, end - 1]
            length = np.ones(size, np.int16)
            chosen = np.full(size, -1, np.int32)
            for k, (keys, chars, ids, scores) in self.by_length.items():
                if k > end:
                    break
                probe = prefix[:, end] - prefix[:, end - k] * self.power[k]
                at = np.searchsorted(keys, probe)
                at[at == len(keys)] = 0
                hit = np.flatnonzero(keys[at] == probe)
                if not len(hit):
                    continue
                at = at[hit]
                same = (chars[at] == codes[hit, end - k : end]).all(axis=1)
                hit, at = hit[same], at[same]
                new = best[hit, end - k] + scores[at]
                better = new >= score[hit]
                hit, at = hit[better], at[better]
                score[hit], length[hit], chosen[hit] = new[better], k, ids[at]
            best[:, end], back[:, end], piece[:, end] = score, length, chosen
        # walk back, all parts together
        out = np.full((size, n), -1, np.int32)
        steps = np.full((size, n), 0, np.int32)
        at, col = np.full(size, n), 0
        rows = np.arange(size)
        while len(rows):
            here = at[rows]
            out[rows, n - 1 - col], steps[rows, n - 1 - col] = piece[rows, here], here
            at[rows] = here - back[rows, here]
            col += 1
            rows = rows[at[rows] > 0]
        if (out[:, n - col :][steps[:, n - col :] > 0] >= 0).all():
            used = steps > 0
            counts = used.sum(axis=1)
            return np.split(out[used], np.cumsum(counts)[:-1])
        return [self._with_bytes(codes[r], [(p, end) for p, end in zip(out[r].tolist(), steps[r].tolist(), strict=True) if end]) for r in range(size)]

    def _with_bytes(self, codes: np.ndarray, path: list[tuple[int, int]]) -> np.ndarray:
        """Ids of a path of pieces and their ends; what has no piece (-1) becomes bytes."""
        ids: list[int] = []
        for p, end in path:
            if p >= 0:
                ids.append(p)
                continue
            c = int(codes[end - 1])
            char = " " if c == _MARK else SPACE_MARK if c == _LITERAL_MARK else chr(c)
            byte_ids = self.table.byte_ids
            ids += [byte_ids[b] for b in char.encode()] if byte_ids else [self.table.unknown_id]
        return np.array(ids, np.int32)

    def _matches(self, codes: np.ndarray, prefix: np.ndarray, first: int, last: int) -> tuple[list[int], ...]:
        """Pieces that end at positions first + 1 to last, by end, then length: where each position's begin, lengths, ids, scores."""
        found = []
        for k, (keys, chars, ids, scores) in self.by_length.items():
            ends = np.arange(max(first + 1, k), last + 1)
            probe = prefix[ends] - prefix[ends - k] * self.power[k]
            at = np.searchsorted(keys, probe)
            at[at == len(keys)] = 0
            hit = np.flatnonzero(keys[at] == probe)
            at, ends = at[hit], ends[hit]
            same = (chars[at] == codes[ends[:, None] - k + np.arange(k)]).all(axis=1)
            found.append((ends[same], np.full(int(same.sum()), k), ids[at[same]], scores[at[same]]))
        ends, lengths, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((lengths, ends))
        begin = np.searchsorted(ends[order], np.arange(first + 1, last + 2))
        return begin.tolist(), lengths[order].tolist(), ids[order].tolist(), scores[order].tolist()

    def _long(self, part: str) -> np.ndarray:
        """Ids of one long part, by the recurrence of _lane."""
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[codes == _MARK] = _LITERAL_MARK
        codes[codes == 32] = _MARK
        n, inverse = len(codes), np.uint64(pow(int(_BASE), -1, 1 << 64))
        up, down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (_BASE, inverse))
        prefix = np.zeros(n + 1, np.uint64)
        prefix[1:] = np.cumsum(_mixed(codes) * down[:n]) * up[:n]
        width = np.where(codes < 0x80, 1, np.where(codes < 0x800, 2, np.where(codes < 0x10000, 3, 4)))
        alone = (self.byte_score * width).tolist()
        best, back, piece = [0] * (n + 1), np.ones(n + 1, np.int16), np.full(n + 1, -1, np.int32)
        for first in range(0, n, SPAN):
            last = min(n, first + SPAN)
            begin, lengths, ids, scores = self._matches(codes, prefix, first, last)
            backs, chosen = [], []
            for end in range(first + 1, last + 1):
                score, length, take = best[end - 1] + alone[end - 1], 1, -1
                for j in range(begin[end - first - 1], begin[end - first]):
                    new = best[end - lengths[j]] + scores[j]
                    if new >= score:
                        score, length, take = new, lengths[j], ids[j]
                best[end] = score
                backs.append(length)
                chosen.append(take)
            back[first + 1 : last + 1], piece[first + 1 : last + 1] = backs, chosen
        path, end = [], n
        while end:
            path.append((int(piece[end]), end))
            end -= int(back[end])
        return self._with_bytes(codes, path[::-1])

    def learn(self, parts: set[str]) -> None:
        """Encodes parts that the memory lacks."""
        new = [p for p in parts if p not in self.memory]
        if len(self.memory) + len(new) > self.most:
            self.memory = {}
            new = list(parts)
        new.sort(key=len)
        a = 0
        while a < len(new):
            n, b = len(new[a]), a
            if n > LONG:
                self.memory[new[a]] = self._long(new[a])
                a += 1
                continue
            most = max(1, LANE // n)
            while b < len(new) and len(new[b]) == n and b - a < most:
                b += 1
            self.memory.update(zip(new[a:b], self._lane(new[a:b]), strict=True))
            a = b

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the number of each."""
        parts_of = [PART.findall(" " + t) if t else [] for t in texts]
        number: dict[str, int] = {}
        index = [np.fromiter((number.setdefault(p, len(number)) for p in parts), np.int64, len(parts)) for parts in parts_of]
        self.learn(set(number))
        memory = self.memory
        pieces = [memory[p] for p in number]
        lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
        starts = np.concatenate([[0], np.cumsum(lens)])[:-1]
        all_parts = np.concatenate(index) if index else np.zeros(0, np.int64)
        each = lens[all_parts]
        ends = np.cumsum(each)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.arange(total) + np.repeat(starts[all_parts] - (ends - each), each)]
        bounds = np.concatenate([[0], ends])
        at = np.cumsum([len(x) for x in index])
        counts = np.diff(np.concatenate([[0], bounds[at]])) if len(index) else np.zeros(0, np.int64)
        return ids, counts.astype(np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")[1:]


_built: dict[tuple[int, int], Encoder] = {}


def _encoder(shared, most: int = MEMORY) -> Encoder:
    key, table = shared.value
    if (key, most) not in _built:
        _built.clear()
        _built[key, most] = Encoder(table, most)
    return _built[key, most]


def _share(df: DataFrame, path: str, table: PieceTable | None):
    table = table or load_pieces(path)
    return df.sparkSession.sparkContext.broadcast((hash((tuple(table.pieces), tuple(table.ranks))), table))


def _blocks(column: pa.Array, most: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of at most so many characters, one text at least."""
    start, block, size = 0, [], 0
    for i, x in enumerate(column):
        t = x.as_py()
        n = len(t) if t else 0
        if block and size + n > most:
            yield start, block
            start, block, size = i, [], 0
        block.append(t)
        size += n
    if block:
        yield start, block


def encode(docs: DataFrame, text: str = "text", path: str = PIECES, table: PieceTable | None = None, verify: bool = False, block: int = BLOCK, memory: int = MEMORY) -> DataFrame:
    """docs without the text, with ids (array<int>) and n_pieces; verify adds round_trip, whether
    decoding the ids gives the text. block: characters encoded at once, memory: parts that a task keeps; fewer take less memory and more time."""
    shared = _share(docs, path, table)
    new = [("ids", T.ArrayType(T.IntegerType(), False)), ("n_pieces", T.LongType())] + [("round_trip", T.BooleanType())] * verify
    names = [n for n, _ in new]
    rest = [c for c in docs.columns if c not in names and c != text]
    fields = [docs.schema[c] for c in rest] + [T.StructField(n, t) for n, t in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared, memory)
        for batch in batches:
            for start, texts in _blocks(batch.column(len(rest)), block):
                ids, counts = encoder.encode(texts)
                null = np.array([t is None for t in texts])
                offsets = np.concatenate([[0], np.cumsum(counts)])
                arrays = [
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(null, False)), pa.array(ids, pa.int32())),
                    pa.array(counts, pa.int64(), mask=null),
                ]
                if verify:
                    same = [None if t is None else (encoder.decode(ids[a:b]) == t if t else b == a) for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True)]
                    arrays.append(pa.array(same, pa.bool_()))
                kept = [c.slice(start, len(texts)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], names=[*rest, *names])

    narrow = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))
    return narrow.mapInArrow(run, T.StructType(fields))


def decode(encoded: DataFrame, ids: str = "ids", path: str = PIECES, table: PieceTable | None = None) -> DataFrame:
    """encoded without the ids, with text."""
    shared = _share(encoded, path, table)
    rest = [c for c in encoded.columns if c not in (ids, "text")]
    fields = [encoded.schema[c] for c in rest] + [T.StructField("text", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            column = batch.column(len(rest))
            texts = [None if x.as_py() is None else encoder.decode(np.array(x.as_py(), np.int32)) for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*rest, "text"])

    narrow = encoded.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{ids}`").alias("__ids"))
    return narrow.mapInArrow(run, T.StructType(fields))
