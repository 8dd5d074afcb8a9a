from __future__ import annotations

import random
import re
from dataclasses import replace
from types import SimpleNamespace

import pyarrow as pa
import pytest

from driftmark.llm import lattice, pieces as pc
from driftmark.llm.common import Scratch
from driftmark.llm.queries import PIECE_MODEL

PIECES = pc.load(PIECE_MODEL)


def brute_ids(text):
    out = []
    for word in re.findall(pc.PRETOKEN, pc.escaped((text or "").replace("▁", " "))):
        best = [(0, [])]
        for end in range(1, len(word) + 1):
            found = None
            for start in range(max(0, end - PIECES.longest), end):
                piece = word[start:end]
                own, ids = PIECES.scores.get(piece), [PIECES.ids.get(piece)]
                if own is None and end - start == 1:
                    own, ids = PIECES.unknown, [PIECES.byte_ids[b] for b in piece.encode()]
                if own is not None and (found is None or best[start][0] + own > found[0]):
                    found = (best[start][0] + own, best[start][1] + ids)
            best.append(found)
        out += best[-1][1]
    return out


def test_words_cut_no_piece_and_lose_nothing():
    rng, alphabet = random.Random(5), "aZ9é語🙂 \n.,:;(\"'²»–—…-_/#\u0301\x00\r\u2028"
    pattern, longest = PIECES.word, PIECES.longest
    for text in ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(3000)]:
        words = re.findall(pattern, pc.escaped(text))
        assert "".join(words) == pc.escaped(text) and all(words)
        inside, at = set(), 0
        for word in words[:-1]:
            at += len(word)
            inside.add(at)
        whole = pc.escaped(text)
        for cut in inside:
            for start in range(max(0, cut - longest), cut):
                for end in range(cut + 1, min(len(whole), start + longest) + 1):
                    assert whole[start:end] not in PIECES.ids


def test_scores_beyond_a_number_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id int, text string")
    with pytest.raises(ValueError, match="too large"):
        lattice.encode(docs, replace(PIECES, unknown=-(1 << 40)))


def texts(rng):
    out = [None, "", " ", "\n", "Hello world", "Schöne Grüße\nund  mehr ", "ñ 🙂🙂 ▁x\x00\ty", "日本語 text", "a" * 30, "x́ ößéż \U0001f9ff", "123 4567"]
    for _ in range(30):
        out.append(rng.choice([" ", "\n", "  "]).join("".join(rng.choices(["th", "er", "Ung", "é", "ation", "x"], k=rng.randint(1, 6))) for _ in range(rng.randint(1, 50))))
    return out


@pytest.mark.parametrize("cache", [0, 25, 1 << 20])
def test_encode_and_decode(spark, cache, monkeypatch, unigram):
    monkeypatch.setattr(lattice, "CACHE_WORDS", cache)
    monkeypatch.setattr(lattice, "CHUNK", 3)
    monkeypatch.setattr(lattice, "LONG_WORD", 0 if cache == 25 else 64)
    rows = [(i, t, "n") for i, t in enumerate(texts(random.Random(cache)))]
    rows += [(4, "Hello world", "n"), (4, "Hello world", "n"), (4, "other", "n"), (None, "Hello world", "n"), (None, None, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    found = lattice.round_trip(lattice.encode(docs, PIECES), PIECES).collect()
    assert sorted((str(r.doc_id), r.ids) for r in found) == sorted((str(i), brute_ids(t)) for i, t, _ in rows)
    assert all(r.lossless for r in found)
    by_id = {r.doc_id: r for r in found}
    for i, t, _ in rows[:len(rows) - 5]:
        if i != 4:
            assert by_id[i].text == (t or "").replace("▁", " ")
            if t and len(t) < 300:
                assert by_id[i].ids == unigram.encode(t)


def test_a_long_word(spark):
    word = "".join(random.Random(3).choices("abcdeth", k=5000))
    docs = spark.createDataFrame([(1, word), (2, "a " * 20_000)], "doc_id int, text string")
    found = {r.doc_id: r.ids for r in lattice.encode(docs, PIECES).collect()}
    assert found == {1: brute_ids(word), 2: brute_ids("a " * 20_000)}


@pytest.mark.parametrize("cache", [0, 1 << 20])
def test_words_about_as_long_as_a_number_holds(spark, cache, monkeypatch):
    monkeypatch.setattr(lattice, "CACHE_WORDS", cache)
    rng = random.Random(7)
    rows = [(n, "".join(rng.choices("abcdethö🙂", k=n))) for n in (1, 2, 31, 32, 33, 62, 63, 64, 65, 66)]
    found = {r.doc_id: r.ids for r in lattice.encode(spark.createDataFrame(rows, "doc_id int, text string"), PIECES).collect()}
    assert found == {n: brute_ids(text) for n, text in rows}


def test_an_edge_of_a_short_word_is_one_number_met_by_a_hash(spark, capsys):
    words = spark.createDataFrame([("▁the",), ("x" * 65,), (None,)], "word string")
    found = lattice.edges(words, lattice.piece_table(spark, PIECES), PIECES)
    assert dict(found.dtypes)["edge"] == "bigint"
    assert found.where("edge is null and far is null").count() == 1
    found.explain()
    assert re.search(r"BroadcastHashJoin \[key#\d+L\], \[key#\d+L\]", capsys.readouterr().out)


def test_the_cache_knows_a_small_part_of_a_small_table(spark):
    """Else rows of rare words grow faster than the table."""
    docs = spark.createDataFrame([(i, f"own{i}") for i in range(400)], "doc_id int, text string")
    cache = lattice.common_words(docs, lattice.piece_table(spark, PIECES), PIECES, Scratch(spark, "test"))
    assert 20 <= cache.count() <= 100


def test_a_block_holds_its_words(monkeypatch):
    monkeypatch.setattr(lattice, "_read", {})
    words, ids = [f"word{i}" for i in range(1000)], [[i, 7] for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(words), pa.array(ids, pa.list_(pa.int32()))], ["word", "known"])
    block, size = lattice._block(batch.slice(10), "<u2")
    assert len(block) < size < batch.nbytes
    known = lattice._known("run", SimpleNamespace(value=[block]))
    assert known == {f"word{i}": bytes([i % 256, i // 256, 7, 0]) for i in range(10, 1000)}


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id int, text string")
    assert lattice.encode(docs, PIECES).count() == 0


def test_documents_move_once(spark, capsys):
    docs = spark.createDataFrame([(1, "some words here")], "doc_id int, text string")
    found = lattice.encode(docs, PIECES)
    found.explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") <= 2 and "Python" not in plan and "Cartesian" not in plan


def test_workers_let_go_of_the_cache(monkeypatch):
    """A worker that has put documents together holds no common words any more."""
    monkeypatch.setattr(lattice, "_read", {"run": {"word": b""}})
    packed = pa.array([b"\x01\x00\xff\xff", b"\x02\x00"], pa.binary())
    gaps = pa.array([[[7, 8]], []], pa.list_(pa.list_(pa.int32())))
    batch = pa.RecordBatch.from_arrays([packed, gaps, pa.array([1, 2])], ["packed", "gaps", "doc_id"])
    found = [r for b in lattice._put_together(iter([batch]), "<u2", ["doc_id"]) for r in b.to_pylist()]
    assert found == [{"doc_id": 1, "ids": [1, 7, 8]}, {"doc_id": 2, "ids": [2]}]
    assert lattice._read == {}
