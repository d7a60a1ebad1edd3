"""Token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. Each node knows how many pieces are popped when
matching fails there, so one pass over a word gives the number of pieces of the greedy
longest-match split without building them: each character is read once, and every failure
link taken pays for characters read before.

A word is matched as the word mark and its characters. A word that cannot be split into pieces
counts as one unknown token.

Defined results: null and empty texts have no words and no tokens; very long texts and words are counted whole, in time in
proportion to their length; a split has no ties, as the longest piece is taken; repeated rows are counted
one by one; an empty table gives an empty result; columns of the input other than the text are passed on unless one has the name of
an output column.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .vocabulary import PIECES, SPACE_MARK, load_pieces

#: Entries of a task's memory of words. It is emptied when full, so it is bounded.
MEMORY = 300_000


class Automaton:
    """Greedy longest-match word pieces: starting pieces begin with the mark, others do not."""

    def __init__(self, pieces: Iterable[str], mark: str = SPACE_MARK):
        self.mark = mark
        pieces = {p for p in pieces if p and mark not in p[1:]}
        # node 0: the start of a word, node 1: the start of a continuation
        self.next: list[dict[str, int]] = [{}, {}]
        piece_at, parent = [False, False], [(-1, ""), (-1, "")]
        for p in sorted(pieces):
            node = 0 if p[0] == mark else 1
            for c in p:
                to = self.next[node].get(c)
                if to is None:
                    to = self.next[node][c] = len(self.next)
                    self.next.append({})
                    piece_at.append(False)
                    parent.append((node, c))
                node = to
            piece_at[node] = True
        n = len(self.next)
        self.fail, self.pops = [-1] * n, [0] * n
        queue = [*self.next[0].values(), *self.next[1].values()]
        for v in queue:  # by breadth, so that links of shorter strings are known
            queue.extend(self.next[v].values())
            u, c = parent[v]
            if piece_at[v]:
                self.fail[v], self.pops[v] = 1, 1
                continue
            z, popped = self.fail[u], self.pops[u]
            while z != -1 and c not in self.next[z]:
                popped += self.pops[z]
                z = self.fail[z]
            if z != -1:
                self.fail[v], self.pops[v] = self.next[z][c], popped
        self.memory: dict[str, int] = {}

    def length(self, word: str) -> int:
        """Pieces of the split; 0 if there is none."""
        nxt, fail, pops = self.next, self.fail, self.pops
        node, n = 0, 0
        for c in self.mark + word:
            to = nxt[node].get(c)
            while to is None:
                n += pops[node]
                node = fail[node]
                if node == -1:
                    return 0
                to = nxt[node].get(c)
            node = to
        while node != 1:
            n += pops[node]
            node = fail[node]
            if node == -1:
                return 0
        return n

    def count(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown words of a text."""
        if not text:
            return 0, 0, 0
        memory, tokens, unknown, n = self.memory, 0, 0, 0
        for raw in text.encode().split():  # bytes are split at ASCII space only
            n += 1
            k = memory.get(raw)
            if k is None:
                if len(memory) >= MEMORY:
                    memory.clear()
                k = memory[raw] = self.length(raw.decode())
            if k:
                tokens += k
            else:
                tokens += 1
                unknown += 1
        return n, tokens, unknown


_built: dict[int, Automaton] = {}


def _automaton(shared) -> Automaton:
    """The automaton of a broadcast list of pieces, built once a Python worker."""
    key = shared.value[0]
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(shared.value[1])
    return _built[key]


def count_tokens(docs: DataFrame, text: str = "text", pieces: Iterable[str] | None = None, path: str = PIECES) -> DataFrame:
    """docs without the text, with n_words, n_tokens and n_unknown (long)."""
    if pieces is None:
        table = load_pieces(path)
        pieces = [p for p, r in zip(table.pieces, table.ranks, strict=True) if r]
    pieces = sorted(pieces)
    shared = docs.sparkSession.sparkContext.broadcast((hash(tuple(pieces)), pieces))
    new = ["n_words", "n_tokens", "n_unknown"]
    rest = [c for c in docs.columns if c not in (*new, text)]
    fields = [docs.schema[c] for c in rest] + [T.StructField(c, T.LongType()) for c in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _automaton(shared)
        for batch in batches:
            column = batch.column(len(rest))
            found = [machine.count(x.as_py()) for x in column]
            counts = [pa.array([f[i] for f in found], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *counts], names=[*rest, *new])

    from pyspark.sql import functions as F

    narrow = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"))
    return narrow.mapInArrow(run, T.StructType(fields))
