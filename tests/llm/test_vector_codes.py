from __future__ import annotations

import math
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from driftmark.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", "clash") for i, v, label in rows], SCHEMA)


def brute(rows):
    """The contract row by row, in Python integers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return [], []
    dim = len(kept[0][1])
    whole = [[math.floor(Fraction(x) * 4096) for x in v] for _, v, _ in kept]
    spans = [(dim * p // 8, dim * (p + 1) // 8) for p in range(8)]
    fit = [w for w in whole if len(w) == dim]
    books = [[w[a:b] for w in fit[:16]] for a, b in spans]

    def nearest(w):
        out = []
        for book, (a, b) in zip(books, spans):
            d = [sum((x - y) ** 2 for x, y in zip(w[a:b], e)) for e in book]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(6):
        members = defaultdict(list)
        for w in fit:
            for p, (e, _) in enumerate(nearest(w)):
                members[p, e].append(w[spans[p][0] : spans[p][1]])
        books = [
            [[sum(c) // len(c) for c in zip(*members[p, e])] if members[p, e] else entry for e, entry in enumerate(book)]
            for p, book in enumerate(books)
        ]
    coded = []
    for (i, _, label), w in zip(kept, whole):
        found = nearest(w) if len(w) == dim else None
        code = "".join(f"{e:02x}" for e, _ in found) if found else None
        coded.append((i, label, code, min(sum(d for _, d in found), vc.LONG_MAX) if found else None))
    return coded, books


def same(spark, rows):
    found, books = vc.compress(frame(spark, rows))
    want, want_books = brute(rows)
    assert books == want_books or not want
    key = repr
    assert sorted((tuple(r) for r in found.collect()), key=key) == sorted(want, key=key)
    return found


def random_rows(n, dim, seed=1, scale=0.2):
    rng = np.random.default_rng(seed)
    return [(i, v, int(i % 3)) for i, v in enumerate((rng.standard_normal((n, dim)) * scale).tolist())]


def test_against_brute_force(spark):
    same(spark, random_rows(150, 16))


def test_several_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK_ROWS", 7)
    rows = random_rows(90, 16, seed=2)
    found, books = vc.compress(frame(spark, rows).repartition(5))
    want, want_books = brute(rows)
    assert books == want_books
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_odd_rows(spark):
    rows = random_rows(20, 11, seed=3)
    rows += [
        (100, None, 1),
        (101, [0.1] * 10 + [None], 1),
        (102, [0.1] * 10 + [float("nan")], 1),
        (103, [0.1] * 10 + [float("-inf")], 1),
        (104, [0.1, 0.2], 2),  # another length: no code
        (None, [0.1] * 11, None),
        (3, [0.3] * 11, None),  # an id twice
        (3, [0.3] * 11, None),  # and a row twice
    ]
    same(spark, rows)


def test_ties_go_to_the_lower_entry(spark):
    found = same(spark, [(i, [0.5] * 8, None) for i in range(30)])
    assert {r.code for r in found.collect()} == {"00" * 8}


def test_few_rows_and_none(spark):
    same(spark, random_rows(3, 8))
    same(spark, [(1, [], 1), (2, [], None)])
    found, books = vc.compress(frame(spark, []))
    assert found.count() == 0 and all(not b for b in books)
    assert vc.with_label_error(found).count() == 0


def test_components_of_any_size(spark):
    rows = random_rows(40, 8, seed=4, scale=1e3) + [(50, [1e300] * 8, 1), (51, [-1e300, 5e-324] * 4, 1), (52, [3e12, -0.0] * 4, 1)]
    same(spark, rows)


def test_label_errors(spark):
    rows = [(1, 7, "00", 5), (2, 7, "00", 6), (3, None, "00", 1), (4, None, "00", 2), (5, 8, None, None), (6, 9, "00", vc.LONG_MAX), (7, 9, "00", 1)]
    found = vc.with_label_error(spark.createDataFrame(rows, "vec_id long, label int, code string, error long"))
    assert {r.vec_id: r.label_error for r in found.collect()} == {1: 11, 2: 11, 3: 3, 4: 3, 5: None, 6: vc.LONG_MAX, 7: vc.LONG_MAX}


@pytest.mark.parametrize("total", [0, 1, -1, 2**40, -(2**100) - 17])
def test_limbs(total):
    assert sum(limb << (vc.LIMB * at) for at, limb in vc._limbs(total)) == total
