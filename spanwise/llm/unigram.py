"""Unigram vocabulary for the Viterbi operators (3 and 7).

Pieces, kinds and scores are those of a public SentencePiece model file (its path is a parameter;
nothing is trained).  Tokenisation is the unigram model's best path over them: white space marks
become ``▁``, one mark is put in front, and a text is cut before each run of marks, which no piece
crosses.  Rules of the best path, as in the public unigram tokenizers: a piece that ends at a position
wins over an earlier candidate (longer piece) only with a strictly higher score; a character that is
no piece itself may be an unknown of score ``lowest - 10``; unknowns become their UTF-8 bytes.
Sums start anew in each word and are exact (64-bit).
"""

from __future__ import annotations

from dataclasses import dataclass, field

MARK = "▁"
UNKNOWN_PENALTY = 10.0
LONG_WORD = 64  # characters; longer words are not kept in the per-process cache


@dataclass
class Vocabulary:
    pieces: dict[str, tuple[float, int]]  # piece -> (score, id); neither control nor byte pieces
    byte_ids: list[int]  # id of each byte value
    unknown_score: float
    size: int
    by_id: list[bytes] = field(repr=False)  # what each id decodes to

    @classmethod
    def load(cls, path: str | None = None) -> Vocabulary:
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, byte_ids, by_id = {}, [0] * 256, []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[3:5], 16)] = i
                by_id.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                by_id.append(b"")
            else:
                pieces[piece] = (float(sp.get_score(i)), i)
                by_id.append(piece.replace(MARK, " ").encode())
        lowest = min(s for s, _ in pieces.values())
        return cls(pieces, byte_ids, lowest - UNKNOWN_PENALTY, sp.get_piece_size(), by_id)


def units(text: str) -> list[str]:
    """The text's words as cut before runs of marks; unit u stands for the marked word of ``mark(u)``."""
    if not text:
        return []
    words = text.replace(MARK, " ").split(" ")
    if "" not in words:
        return words
    out, run = [], 0
    for w in words:
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    if run:
        out.append(" " * (run - 1))
    return out


def mark(unit: str) -> str:
    return MARK + unit.replace(" ", MARK)
