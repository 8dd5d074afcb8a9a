from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from driftmark.llm import jaccard, simhash
from driftmark.llm.common import Scratch
from pyspark.sql import functions as F


def brute_fingerprint(text, size=4):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    size = min(size, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]).encode(), 42) for i in range(len(words) - size + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.none(), st.text(alphabet="aB É\x85\xa0\t\n\x0b\x0c\r 🙂", max_size=60)))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_of_a_long_text(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    text = " ".join(random.Random(1).choices(["a", "bb", "ccc", "É"], k=500))
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_hash_is_that_of_spark(spark):
    row = spark.sql("SELECT xxhash64('one two three four') AS h").first()
    assert row.h % (1 << 64) == xxhash.xxh64_intdigest(b"one two three four", 42)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_links(values, max_bits):
    return {(a, b) for a in values for b in values if signed(a) < signed(b) and (a ^ b).bit_count() <= max_bits}


@pytest.mark.parametrize("max_bits", [0, 1, 3, 4, 5, 7])
def test_links_against_all_pairs(spark, max_bits):
    rng = random.Random(max_bits)
    values = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(40):
        base = rng.getrandbits(64)
        values |= {base}
        for _ in range(6):
            twin = base
            for bit in rng.sample(range(64), rng.randint(1, 9)):
                twin ^= 1 << bit
            values.add(twin)
    fps = spark.createDataFrame([(signed(v), signed(v)) for v in values], "fp long, part long")
    found = Counter((r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(fps, max_bits).collect())
    want = brute_links(values, max_bits)
    assert set(found) == want and set(found.values()) <= {1}
    assert {tuple(sorted((r.a % (1 << 64), r.b % (1 << 64)), key=signed)) for r in simhash.star_links(fps.select("fp"), max_bits).collect()} <= want


def test_components_against_all_pairs(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \n ", "One two three", "one TWO  three", "one two three four", "É é É é"]
    for _ in range(25):
        words = rng.choices(vocabulary, k=rng.randint(5, 400))
        texts += [" ".join(words)] * rng.randint(1, 3)
        for _ in range(4):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            texts.append(" ".join(near))
    rng.shuffle(texts)
    rows = [(1000 - 3 * i, t, 1, 2) for i, t in enumerate(texts)] + [(1000, texts[0], 1, 2), (None, texts[1], 1, 2), (None, "alone here", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int, component_id int")
    fps = [brute_fingerprint(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    least: dict = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    want = Counter((row[0], f"{fps[i]:016x}", least.get(root(i))) for i, row in enumerate(rows))
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id")
    assert Counter(tuple(r) for r in found.collect()) == want
    assert len(set(least.values())) < len(texts) - 20
    assert simhash.near_duplicates(docs.where(F.lit(False))).count() == 0


def test_only_measured_sizes_are_broadcast(spark, monkeypatch):
    """Behind an explode Spark takes an index of any size for as small as the file it comes from."""
    planned, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    fps = spark.range(50).selectExpr("id as fp", "id as part")

    def plan():
        return simhash.links(fps)._jdf.queryExecution().executedPlan().toString()

    # What would be gathered on the driver is 64 times as many rows.
    assert "BroadcastExchange" in plan()
    before, seen = spark.conf.get(planned), []

    class Rows:
        schema = fps.schema
        write = property(lambda self: self)

        def mode(self, _):
            return self

        def parquet(self, _):
            seen.append((spark.conf.get(planned), spark.conf.get(measured), plan()))

    monkeypatch.setattr(Scratch, "read", lambda *_: None)
    Scratch(spark, "test").settle("rows", Rows())
    assert seen[0][:2] == ("-1", before) and "BroadcastExchange" not in seen[0][2]
    assert spark.conf.get(planned) == before and spark.conf.get(measured, None) is None
    monkeypatch.undo()
    docs = spark.createDataFrame([(i, f"some words of text {i}") for i in range(20)], "doc_id long, text string")
    for found in (simhash.near_duplicates(docs), jaccard.near_duplicates(docs)):
        assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
