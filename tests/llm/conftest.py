from __future__ import annotations

import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from driftmark.llm import pieces as pc
from driftmark.llm.queries import PIECE_MODEL


@pytest.fixture(scope="session")
def unigram():
    """The library's own encoder, told to read the same pieces and scores as a unigram model."""
    pieces = pc.load(PIECE_MODEL)
    model = sentencepiece_model_pb2.ModelProto()
    with open(PIECE_MODEL, "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = pc.UNIGRAM
    for p in model.pieces:
        if p.type == p.NORMAL:
            p.score = pieces.scores[p.piece] / pc.SCALE
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
