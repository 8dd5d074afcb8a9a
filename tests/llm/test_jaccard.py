from __future__ import annotations

import random
import re

import pytest

import corpus_pipeline as cp
from driftmark.llm import jaccard
from driftmark.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(text, size=5):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def brute_similarity(left, right):
    return len(left & right) / len(left | right) if left | right else 1.0


def brute_components(rows, least=0.8):
    """The smallest doc_id of each row's group, nulls last."""
    sets, parent = [brute_shingles(t) for _, t in rows], list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if brute_similarity(sets[i], sets[j]) >= least:
                parent[root(i)] = root(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            groups[root(i)] = min(doc_id, groups.get(root(i), doc_id))
    return [groups.get(root(i)) for i in range(len(rows))]


def changed(text, rng, n):
    found = text.split()
    for i in rng.sample(range(len(found)), n):
        found[i] = f"new{rng.random()}"
    return " ".join(found)


def prose(rng, n):
    return " ".join(f"w{rng.randrange(3000)}" for _ in range(n))


def corpus(rng):
    """Copies with one to three words changed, chains of them, families around one text, and texts
    with a common half, which must stay apart."""
    texts = [None, "", " \t", "one two", "One  TWO", "one three", "é a b c d", "É a b c d", "a b c d e f", "a b c d e"]
    for i in range(20):
        base = prose(rng, rng.randint(60, 140))
        texts += [base, changed(base, rng, 1), changed(base, rng, 2), changed(changed(base, rng, 1), rng, 2), base.upper()]
    base = prose(rng, 100)
    texts += [changed(base, rng, 1 + i % 3) for i in range(40)] + [base]
    half = prose(rng, 80)
    texts += [f"{half} {prose(rng, 60)}" for _ in range(15)]
    rng.shuffle(texts)
    return [*enumerate(texts), (3, prose(rng, 9)), (3, texts[3]), (None, texts[4]), (None, prose(rng, 50))]


def test_shingles():
    for text in (None, "", "a", "A b\tC\x0bd\x0ce F\r\ng", "a\xa0b \x85 c \x1c d e f", "ÉÀ B"):
        assert {tuple(s.decode().split(" ")) for s in jaccard.shingles(text)} == brute_shingles(text)


@pytest.mark.parametrize("block", [7, 512])
def test_recall_of_keys(monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng, found, near = random.Random(block), 0, 0
    for _ in range(600):
        text = prose(rng, 100)
        twin = changed(text, rng, rng.randint(1, 2))
        if brute_similarity(brute_shingles(text), brute_shingles(twin)) >= 0.8:
            near += 1
            found += bool((jaccard.signature(text)[1] == jaccard.signature(twin)[1]).any())
    assert near > 400 and found >= near - 1


def test_components_against_all_pairs(spark):
    rows = corpus(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(map(str, ((r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect())))
    assert found == sorted(map(str, ((d, c) for (d, _), c in zip(rows, brute_components(rows)))))


def test_links_between_groups(spark):
    """A text far from its key's smallest node is still linked with others of the key."""
    rng = random.Random(5)
    base = prose(rng, 100)
    chain = [base]
    for _ in range(30):
        chain.append(changed(chain[-1], rng, 1))
    rng.shuffle(chain)
    docs = spark.createDataFrame([*enumerate(chain)], "doc_id long, text string")
    assert {r.component_id for r in jaccard.near_duplicates(docs).collect()} == {0}


def test_stage_drops_copies_with_a_word_changed(spark, tmp_path):
    rng, rows = random.Random(7), []
    for i in range(30):
        text = prose(rng, 100)
        rows += [(3 * i, text), (3 * i + 1, changed(text, rng, 1)), (3 * i + 2, prose(rng, 100))]
    docs = spark.createDataFrame([(d, t, "aa", "s", len(t)) for d, t in rows], SCHEMA)
    stays = sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, str(tmp_path)).collect())
    assert stays == [d for d, _ in rows if d % 3 != 1]


@pytest.fixture
def settled(monkeypatch):
    """Rows of each scratch table that was written."""
    counts, settle = {}, Scratch.settle

    def counted(self, table, rows):
        found = settle(self, table, rows)
        counts[table] = found.count()
        return found

    monkeypatch.setattr(Scratch, "settle", counted)
    return counts


def test_candidates_by_fingerprints(spark, settled):
    """SimHash and its variants give the pairs of close fingerprints, and the stage's candidates hold them."""
    rows = [(10, 5), (11, 5), (12, 5 ^ (1 << 63) - (1 << 62)), (13, 5 ^ 0b1111 << 20), (14, 5 ^ 0b11111 << 40), (15, -1)]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    found = jaccard.fingerprint_pairs(nodes, Scratch(spark, "test"))
    assert {frozenset(r) for r in found.collect()} >= {frozenset(p) for p in ((10, 11), (10, 12), (10, 13))}
    assert not {14, 15} & {n for r in found.collect() for n in r}
    rng, rows = random.Random(11), []
    for i in range(12):
        text = prose(rng, 400)
        rows += [(2 * i, text), (2 * i + 1, changed(text, rng, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in jaccard.near_duplicates(docs).collect()} == {(d, d - d % 2) for d, _ in rows}
    assert settled["by-fingerprint"] >= 6


def test_pairs_of_a_family_that_is_not_alike(spark, settled):
    """Copies of a text that isn't there, each with three words changed, have keys in common but are not
    alike. Their pairs are not built."""
    rng = random.Random(13)
    base = prose(rng, 100)
    rows = [*enumerate(changed(base, rng, 3) for _ in range(150))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert [found[d] for d, _ in rows] == brute_components(rows)
    assert settled["index"] > 300 and settled["cross-pairs"] < 150
