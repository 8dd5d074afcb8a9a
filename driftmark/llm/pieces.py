"""Pieces and scores of a SentencePiece model file, read as a unigram model."""

from __future__ import annotations

import math
import re
import string
from dataclasses import dataclass

BLANK = "▁"
# Scores are whole numbers of this part, so sums are exact and ties are ties in every engine.
SCALE = 1 << 16
UNIGRAM = 1
# Pre-tokens: what no piece reaches across.
PRETOKEN = f"{BLANK}+[^{BLANK}\\n]*|\\n|[^{BLANK}\\n]+"


@dataclass(frozen=True)
class Pieces:
    """Ordinary pieces with id and scaled score, the ids of the 256 byte pieces, and what a
    character without a piece of its own costs."""

    ids: dict[str, int]
    scores: dict[str, int]
    byte_ids: list[int]
    unknown: int
    texts: list[str]

    @property
    def longest(self) -> int:
        return max(map(len, self.ids))

    @property
    def word(self) -> str:
        """Pattern of the shortest parts of a text that no piece is known to reach across: pre-tokens,
        cut where a punctuation mark follows a character that no piece has before such a mark. Marks
        that some piece has behind a letter or digit don't cut."""
        pairs = {pair for piece in self.ids for pair in zip(piece, piece[1:])}
        plain = string.ascii_letters + string.digits
        marks = [m for m in string.punctuation if not any((c, m) in pairs for c in plain)]
        if not marks:
            return PRETOKEN
        before = {a for a, b in pairs if b in marks} - {*marks, BLANK}

        def one_of(chars) -> str:
            return "".join(f"\\x{ord(c):02x}" if ord(c) < 0x80 else c for c in sorted(chars))

        joins, cuts = f"[{one_of({*marks, *before})}]", f"[^{BLANK}\\n{one_of({*marks, *before})}]"
        # A run of other characters goes on only with one of ``before``.
        on = f"(?:{cuts}++[{one_of(before)}]{joins}*+)*+" if before else ""
        return f"\\n|(?=[^\\n]){BLANK}*+{joins}*+{on}{cuts}*+"


def load(path: str) -> Pieces:
    """Read a model file on the driver.

    A unigram model's scores are taken as they are. A merge model has no probabilities, only the
    order of its merges; its pieces are read as a unigram model in which the probability of a piece
    falls with its place by Zipf's law. A character without a piece costs 10 more than the worst
    piece and is encoded by its bytes. Models whose pieces reach across a blank or a line end, or
    that lack byte pieces, are refused.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    kind = model.SentencePiece.Type
    normal = [(i, p) for i, p in enumerate(model.pieces) if p.type == kind.NORMAL]
    if any(len(re.findall(PRETOKEN, p.piece)) != 1 for _, p in normal):
        raise ValueError("a piece reaches across pre-tokens")
    of_byte = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kind.BYTE}
    if len(of_byte) != 256:
        raise ValueError("the model has no piece for some byte")
    if model.trainer_spec.model_type == UNIGRAM:
        raw = {p.piece: p.score for _, p in normal}
    else:
        raw = {p.piece: -math.log(place + 2.7) for place, (_, p) in enumerate(normal)}
    scores = {piece: round(score * SCALE) for piece, score in raw.items()}
    return Pieces(
        ids={p.piece: i for i, p in normal},
        scores=scores,
        byte_ids=[of_byte[b] for b in range(256)],
        unknown=min(scores.values()) - 10 * SCALE,
        texts=[p.piece if p.type == kind.NORMAL else "" for p in model.pieces],
    )


def escaped(text: str | None) -> str:
    """A text as pieces see it: blanks as ``▁``, one before the text; nothing for no text."""
    return BLANK + text.replace(" ", BLANK) if text else ""
