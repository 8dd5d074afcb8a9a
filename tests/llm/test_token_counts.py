from __future__ import annotations

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmark.llm import pieces as pc
from driftmark.llm.queries import PIECE_MODEL
from driftmark.llm.token_counts import PrefixTrie, token_counts

PIECES = pc.load(PIECE_MODEL)


def brute_path(word):
    """Best (score, number of tokens) over all ways to cut a short pre-token."""
    best = [(0, 0)]
    for end in range(1, len(word) + 1):
        found = None
        for start in range(end):
            own = PIECES.scores.get(word[start:end])
            cost = 1
            if own is None and end - start == 1:
                own, cost = PIECES.unknown, len(word[start:end].encode())
            if own is not None and (found is None or best[start][0] + own > found[0]):
                found = (best[start][0] + own, best[start][1] + cost)
        best.append(found)
    return best[-1][1]


SAMPLES = ["Hello world", "Schöne Grüße\nund  mehr", "ñandú 🙂🙂 ▁x", "a", "\n\n", "   ", "日本語 text", "x\ty\x00z", "antidisestablishmentarianism"]


def count(text):
    words = re.findall(pc.PRETOKEN, pc.escaped(text))
    counts = PrefixTrie(PIECES).counts(words)
    return sum(counts[w] for w in words)


@pytest.mark.parametrize("text", SAMPLES)
def test_counts_are_those_of_the_library(unigram, text):
    assert count(text) == len(unigram.encode(text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="▁thearing\n éß🙂", min_size=1, max_size=14), max_size=12))
def test_shared_prefixes_change_nothing(words):
    words = [w for word in words for w in re.findall(pc.PRETOKEN, word.replace(" ", "▁"))]
    assert PrefixTrie(PIECES).counts(words) == {w: brute_path(w) for w in words}


def test_token_counts(spark, unigram):
    rng = random.Random(4)
    texts = [None, "", *SAMPLES, SAMPLES[0], "q" * 20_000]
    texts += [" ".join("".join(rng.choices(["th", "er", "ung", "é", "ation", "x"], k=rng.randint(1, 5))) for _ in range(40)) for _ in range(20)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "Hello world", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    found = {r.doc_id: r for r in token_counts(docs, PIECES).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        assert found[i].n_tokens == count(text)
        if text and len(text) < 400:
            assert found[i].n_tokens == len(unigram.encode(text))
    assert token_counts(docs.limit(0), PIECES).count() == 0
