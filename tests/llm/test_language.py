from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from driftmark.llm import language as lg

SYLLABLES = {"aa": "ka ti mo re su", "bb": "schl ung ein pf ö", "cc": "eau ç ê oui gn", "dd": "ñ lla ción ez rr"}


def prose(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))).capitalize() for _ in range(n))


def corpus(rng):
    rows = [(i, prose(lang, rng, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=400))]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !!", "cc"), (1003, "katimo ka", None), (None, "schlung ein", "bb"), (1004, "привет", "dd")]
    rows += [(1005, prose("cc", rng, 30_000), "cc"), rows[0]]
    return rows


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 8, 30, 64])
def test_codewords(n):
    code = lg.codewords(n)
    assert len(code) == n and set(np.unique(code)) <= {1, -1}
    assert len({tuple(r) for r in code}) == n
    if n > 1:
        assert (abs(code.sum(axis=0)) < n).all()  # no bit is the same for all
        least = min((a != b).sum() for i, a in enumerate(code) for b in code[:i])
        assert least >= (2 ** (n - 2) if n <= 7 else code.shape[1] // 2)


def brute_mean(model, text):
    raw, total, seen = text.encode().translate(lg._FOLD), np.zeros(model.code.shape[1]), 0
    for row, order in enumerate(lg.ORDERS):
        for i in range(len(raw) - order + 1):
            code = int.from_bytes(raw[i : i + order], "little") * 2654435761 % (1 << 32)
            total += model.weights[(code >> (32 - lg.BUCKET_BITS)) + (row << lg.BUCKET_BITS)]
            seen += 1
    return total / max(seen, 1)


def test_pieces_don_t_change_scores(monkeypatch):
    rng = random.Random(3)
    counts = {x: np.random.default_rng(i).integers(0, 50, lg.SIZE) for i, x in enumerate("pqr")}
    model = lg.Model.of(counts)
    texts = ["a", "", "Ö", *(prose("bb", rng, k) for k in (1, 5, 40, 90))]
    monkeypatch.setattr(lg, "PIECE", 37)
    found = model.bits([t.encode().translate(lg._FOLD) for t in texts])
    assert np.allclose(found, [brute_mean(model, t) for t in texts], atol=1e-5)


def test_single_wrong_bits_are_corrected():
    model = lg.Model.of({x: np.random.default_rng(i).integers(1, 9, lg.SIZE) for i, x in enumerate("abcd")})
    model.trust[:] = 1 / model.code.shape[1]
    for i, word in enumerate(model.code):
        for j in range(len(word)):
            bits = word.astype(float).copy()
            bits[j] *= -1
            best, lead = model.decode(bits[None])
            assert best[0] == i and 0 < lead[0] < model.decode(word.astype(float)[None])[1][0]


def test_identify_held_out(spark):
    rows = corpus(random.Random(1))
    docs = spark.createDataFrame([(*r, 0.5, "n") for r in rows], "doc_id long, text string, lang string, score double, bucket string")
    found = lg.identify(docs).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    for i, text, lang in rows:
        r = by_id[i]
        assert r.held_out == (i is None or zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
        if not text or not any(c.isalpha() for c in text):
            assert (r.lang_pred, r.score, r.ambiguous) == ("und", 0, False)
    judged = [(by_id[i], lang) for i, _, lang in rows if i is not None and i < 1000]
    apart = [r.lang_pred == lang for r, lang in judged if r.held_out]
    assert len(apart) > 60 and np.mean(apart) > 0.97
    assert by_id[1003].lang_pred == "aa" and by_id[1005].lang_pred == "cc" and by_id[None].lang_pred == "bb"


def test_nothing_is_learned_from_held_out_rows(spark):
    rows = corpus(random.Random(2))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    turned = [(i, t, "zz" if i is None or zlib.crc32(str(i).encode()) % 4 == 2 else x) for i, t, x in rows]
    other = lg.identify(spark.createDataFrame(turned, docs.schema))
    key = lambda r: (r.doc_id or -1, r.lang_pred, r.score)
    assert sorted(map(key, lg.identify(docs).collect())) == sorted(map(key, other.collect()))


def test_few_labels(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "xyz", "en")], "doc_id long, text string, lang string")
    assert lg.identify(docs.limit(0)).count() == 0
    none = lg.predict(docs, lg.train(docs.where("lang = 'q'")))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    one = lg.predict(docs, lg.train(docs))
    assert [(r.lang_pred, r.score) for r in one.collect()] == [("en", 1.0)] * 2
