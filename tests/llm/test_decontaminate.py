from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from driftmark.llm import decontaminate as dc
from driftmark.llm.fm_index import FmIndex, suffix_array
from pyspark.sql import functions as F

WORD = re.compile(dc.WORD)


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, window):
    phrases: dict = {}
    for i, text in items:
        w = words(text)
        if i is not None and w:
            for at in range(max(1, len(w) - window + 1)):
                phrases.setdefault(tuple(w[at : at + window]), set()).add(str(i))
    out = Counter()
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for p, ids in phrases.items():
            for at in range(len(w) - len(p) + 1):
                if tuple(w[at : at + len(p)]) == p:
                    hit |= set(range(at, at + len(p)))
                    found |= ids
        out[(i, len(w), tuple(sorted(hit)), tuple(sorted(found)))] += 1
    return out


def flat(found):
    out = Counter()
    for r in found.collect():
        hit = tuple(w for s in r.spans for w in range(s["first"], s["last"]))
        assert all(a["last"] < b["first"] for a, b in zip(r.spans, r.spans[1:]))
        out[(r.doc_id, r.n_words, hit, tuple(r["items"]))] += 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_index_against_scan(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, 300)
    text[40:80] = text[100:140]
    text[-1] = 0
    order = suffix_array(text)
    assert sorted(order.tolist()) == list(range(300))
    index = FmIndex(text, 9)
    phrases = np.zeros((60, 6), np.int64)
    lengths = rng.integers(1, 7, 60)
    for row, n in zip(phrases, lengths):
        row[:n] = rng.integers(1, 4, n)
    phrases[0, 0] = 9
    low, high = index.search(phrases, lengths)
    for row, n, a, b in zip(phrases, lengths, low, high):
        want = [i for i in range(300 - n + 1) if (text[i : i + n] == row[:n]).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then some more words"),
    (2, "short ITEM"),
    (3, "é"),
    (4, None),
    (5, "... !"),
    (None, "no id here"),
    (6, "the quick brown fox jumps over the lazy dog and nothing"),
    (2, "short item"),
]


def fixture(rng):
    rows = [(0, None), (1, ""), (2, "x É y é z"), (3, "A Short, item; short item"), (4, "?"), (None, "short item"), (3, "A Short, item; short item")]
    vocabulary = sorted({w for _, t in ITEMS for w in words(t)} | {"other", "ü", "🙂"})
    for i in range(10, 60):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        if i % 3 == 0:
            w = words(ITEMS[i % 2 * 6][1])
            a = rng.randint(0, 4)
            text[len(text) // 2 : len(text) // 2] = w[a:]
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(t.upper() if t.isascii() and rng.random() < 0.3 else t for t in text)))
    rows.append((99, "filler " * 30_000 + "short item"))
    return rows


@pytest.mark.parametrize("window,block,part", [(10, 200_000, 1_000_000), (3, 200_000, 40), (3, 5, 1_000_000)])
def test_contamination_against_brute_force(spark, window, block, part, monkeypatch):
    monkeypatch.setattr(dc, "PART_WORDS", part)
    rows = fixture(random.Random(window))
    docs = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, items int, key string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = dc.contamination(docs, items, window=window, block_phrases=block)
    assert flat(found) == brute(rows, ITEMS, window)
    if block == 5:
        assert dc.phrases_of(items, window).count() > 2 * block


def test_spans_cut_text(spark):
    text = "Één ✓ before; THE quick brown-fox jumps over the lazy dog and: after. Short  item! end"
    docs = spark.createDataFrame([(1, text), (2, "clean 🙂 text"), (3, None)], "doc_id int, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    found = dc.contamination(docs, items).withColumnRenamed("doc_id", "id")
    cut = docs.join(found, F.col("doc_id") == F.col("id")).select("doc_id", dc.without_spans(F.col("text"), F.col("spans")))
    assert dict(map(tuple, cut.collect())) == {1: "Één ✓ before; : after. ! end", 2: "clean 🙂 text", 3: None}


def test_empty_tables(spark):
    docs = spark.createDataFrame([("a", "short item")], "doc_id string, text string")
    items = spark.createDataFrame(ITEMS, "item_id int, text string")
    assert [tuple(r) for r in dc.contamination(docs, items.limit(0)).collect()] == [("a", 2, [], [])]
    assert dc.contamination(docs.limit(0), items).count() == 0
