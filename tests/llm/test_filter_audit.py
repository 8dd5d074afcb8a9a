from __future__ import annotations

import random
import re
from itertools import permutations
from math import factorial

from driftmark.llm import filter_audit as fa

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fails(rows):
    """Failed filters of every (doc_id, text, lang), read off the definitions."""
    out = []
    for doc_id, text, _ in rows:
        t = text or ""
        words = WORD.findall(t)
        found = set()
        if len(words) < 200:
            found.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            found.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t):
            found.add("C")
        if re.search(r"[#$%&*|]", t):
            found.add("D")
        if doc_id is not None and any(i is not None and i < doc_id and (x or "") == t for i, x, _ in rows):
            found.add("E")
        out.append(found)
    return out


def brute(rows, labels):
    """Every order applied to every document, one step after the other."""
    failed = fails(rows)
    good, toxic = ({i for i, *s in labels if i is not None and s[k] == 1} for k in (0, 1))
    out = {}
    for part in {lang or "" for *_, lang in rows}:
        mine = [(r[0], f) for r, f in zip(rows, failed) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = mine
            for step, name in enumerate(order, 1):
                gone = [i for i, f in left if name in f]
                out[part, "".join(order), step] = [
                    len(left) - len(gone),
                    len(gone),
                    sum(name in f for _, f in mine) - len(gone),
                    sum(f == {name} for _, f in mine),
                    sum(i in good for i in gone),
                    sum(i in toxic for i in gone),
                ]
                left = [d for d in left if name not in d[1]]
                shapley[name] += len(gone)
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def run(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, n int, bits int, part string")
    said = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    found = fa.audit(docs, said).collect()
    out = {(r.part, r.filter_order, r.step): list(r)[3:] for r in found}
    assert len(out) == len(found)
    return out


def corpus(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "delta", f"w{rng.randrange(900)}"]) for _ in range(rng.choice([0, 3, 199, 200, 400]))]
        if rng.random() < 0.3:
            words.insert(0, rng.choice("#$%&*|"))
        text = rng.choice([" ", "\n", "\t\x0b"]).join(words)
        rows.append((i, rows[rng.randrange(i)][1] if i and rng.random() < 0.4 else text, rng.choice(["en", "de", None, ""])))
    return rows


def test_against_every_order(spark):
    rows = corpus(80)
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 80, 2)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_odd_rows(spark):
    long = "w " * 120_000
    rows = [
        (1, None, "en"),
        (2, "", "en"),  # a copy of the null text
        (None, "", "en"),  # without an id: no copy
        (3, long, None),
        (3, long, ""),  # shares id and text: no copy
        (4, long, "fr"),
        (5, "é" * 97 + "ABC", "de"),  # exactly 3 of 100 code points
        (6, "é" * 96 + "ABCD", "de"),
        (7, " #  ", "de"),
    ]
    labels = [(1, None, None), (2, 1, None), (2, 0, 1), (None, 1, 1), (3, 1, 0), (99, 1, 1)]
    assert run(spark, rows, labels) == brute(rows, labels)


def test_empty_tables(spark):
    assert run(spark, [], []) == {}
    rows = corpus(5, seed=3)
    assert run(spark, rows, []) == brute(rows, [])


def test_paths_of_the_lattice():
    edges = fa.lattice("ABCDE")
    assert len(edges) == 80
    for e in edges:
        size = bin(e.state).count("1")
        assert e.ways == factorial(size) * factorial(4 - size)
    for name in "ABCDE":
        assert sum(e.ways for e in edges if e.name == name) == 120
