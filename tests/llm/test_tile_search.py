from __future__ import annotations

import math

import numpy as np
import pytest
from driftmark.llm import tile_search as ts

SCHEMA = "vec_id long, embedding array<{}>, label int, query_id long, rank string"


def frame(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, 5, "clash") for i, v in rows], SCHEMA.format(kind))


def brute(rows, k=20, every=20):
    fit = [(i, v) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for q, v in fit:
        if q % every == 0:
            scored = []
            for c, w in fit:
                if c != q and len(w) == len(v):
                    total = 0.0
                    for a, b in zip(v, w):
                        total += a * b
                    scored.append((-total if not math.isnan(total) else math.inf, c))
            out += [(q, n, c, -s) for n, (s, c) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def found(df):
    return sorted(map(tuple, df.collect()))


def rows_of(n, dim, seed=0, single=False):
    vectors = np.random.default_rng(seed).standard_normal((n, dim))
    return list(enumerate((vectors.astype(np.float32) if single else vectors).astype(float).tolist()))


@pytest.mark.parametrize("kind", ["double", "float"])
def test_against_brute_force(spark, kind):
    rows = rows_of(300, 24, single=kind == "float")
    assert found(ts.self_search(frame(spark, rows, kind))) == brute(rows)


def test_many_blocks_and_cells(spark, monkeypatch):
    monkeypatch.setattr(ts, "QUERY_ROWS", 3)
    monkeypatch.setattr(ts, "CANDIDATE_ROWS", 11)
    monkeypatch.setattr(ts, "CHUNK", 5)
    monkeypatch.setattr(ts, "grid", lambda q, c, cores: (2, 3))
    rows = rows_of(200, 8, seed=1)
    df = frame(spark, rows).repartition(3)
    assert found(ts.self_search(df, every=5)) == brute(rows, every=5)


def test_ties_and_copies(spark):
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(90)] + [(100 + i, v) for i, v in rows_of(60, 3)]
    assert found(ts.self_search(frame(spark, rows))) == brute(rows)


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.25]), (1, [0.5, 0.25]), (2, [0.25, 3.0])]
    assert found(ts.self_search(frame(spark, rows), k=2)) == brute(rows, k=2)


def test_odd_rows(spark):
    rows = rows_of(45, 4, seed=2) + [
        (60, None), (80, []), (100, [0.0] * 4), (120, [None, 1.0, 1.0, 1.0]), (140, [float("nan"), 1.0, 1.0, 1.0]),
        (160, [float("inf"), 1.0, 1.0, 1.0]), (None, [9.0] * 4), (180, [1.0, 2.0]), (181, [3.0, 1.0]), (-20, [1.0] * 4),
    ]
    assert found(ts.self_search(frame(spark, rows))) == brute(rows)


def test_few_rows_and_none(spark):
    assert found(ts.self_search(frame(spark, []))) == []
    assert found(ts.self_search(frame(spark, [(0, [1.0])]))) == []
    assert found(ts.self_search(frame(spark, [(0, [1.0]), (7, [-2.0])]))) == [(0, 1, 7, -2.0)]


def test_very_large_and_very_small(spark):
    rows = rows_of(40, 4, seed=5) + [
        (60, [1e300, -1e300, 1.0, 0.0]), (61, [1e300, 1e300, 0.0, 1.0]), (62, [1e-300, 5e-324, 0.0, 0.0]), (80, [5e-324] * 4),
        (100, [1e-200, 0.0, 0.0, 0.0]), (101, [1e200, 0.0, 0.0, 0.0]),
    ]
    assert found(ts.self_search(frame(spark, rows))) == brute(rows)


def test_long_vectors(spark):
    rows = rows_of(45, 1500, seed=6)
    assert found(ts.self_search(frame(spark, rows))) == brute(rows)


def test_bound_holds():
    rng = np.random.default_rng(7)
    a = rng.standard_normal((50, 40)) * 10.0 ** rng.integers(-3, 3, (50, 1))
    codes, (scale, length, rest) = ts.quantise(a)
    coded = (codes.astype(int) @ codes.T.astype(int)) * scale[:, None] * scale
    off = np.outer(length + rest, rest) + np.outer(rest, length)
    assert (np.abs(coded - a @ a.T) <= off).all()


def test_grid_covers_cores_and_work():
    assert ts.grid(0, 0, 6) == (1, 6)
    rows, columns = ts.grid(3_700_000, 73_000_000, 4000)
    assert rows * columns >= 3_700_000 * 73_000_000 / ts.CELL_PAIRS and 0.5 < columns / rows / 20 < 2
