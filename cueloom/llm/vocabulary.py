"""Piece tables of public tokenizers. A path is a parameter; only the driver opens the file, and
the bounded table goes to the tasks in a broadcast variable."""

from __future__ import annotations

from dataclasses import dataclass

SPACE_MARK = "▁"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class PieceTable:
    pieces: list[str]
    #: Rank of an ordinary piece from 1, 0 for others.
    ranks: list[int]
    byte_ids: list[int]
    unknown_id: int


def load_pieces(path: str = PIECES) -> PieceTable:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces = [model.id_to_piece(i) for i in range(n)]
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i) for i in range(n)]
    order = sorted((i for i in range(n) if not special[i]), key=lambda i: -model.get_score(i))
    ranks = [0] * n
    for rank, i in enumerate(order, 1):
        ranks[i] = rank
    by_byte = {pieces[i]: i for i in range(n) if model.is_byte(i)}
    byte_ids = [by_byte[f"<0x{b:02X}>"] for b in range(256)] if len(by_byte) == 256 else []
    return PieceTable(pieces, ranks, byte_ids, model.unk_id())
