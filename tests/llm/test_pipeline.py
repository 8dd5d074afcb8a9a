from __future__ import annotations

import random
from collections import Counter, defaultdict

import corpus_pipeline as cp
from driftmark.llm import language
from test_decontaminate import brute as brute_hits
from test_decontaminate import words
from test_lattice import brute_ids
from test_simhash import brute_fingerprint
from test_urls_lines_quality import brute_lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = {"aa": "ka ti mo re su", "bb": "schl ung ein pf ö"}


def prose(lang, rng, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang].split(), k=rng.randint(1, 4))) for _ in range(n))


def corpus(rng):
    line = prose("aa", rng, 12)
    passage = prose("bb", rng, 14)
    texts = [None, "", "?? 12", line, f"{line}\n{line.upper()}"]
    for i in range(40):
        lang = rng.choice(["aa", "bb"])
        texts.append(prose(lang, rng, rng.randint(2, 60)))
        if i % 6 == 0:
            texts[-1] += f"\n{line}\nend {i}"
        if i % 7 == 0:
            texts[-1] = f"{texts[-1]} {passage} {prose(lang, rng, 5)}"
        if i % 9 == 0:
            texts += [texts[-1], texts[-1].upper()]
    texts.append(passage)
    rows = [(i, t, "bb" if t and "schl" in t.lower() else "aa", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[8], (9, "ka ti mo re su " * 5, "aa", None, None), (None, rows[10][1], None, "s", 1), (None, prose("aa", rng, 30), "aa", "s", 5)]
    return rows, [(7, passage + " ka"), (8, None)]


def kept(stage, spark, rows, folder):
    docs = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA + ", text2 int")
    found = stage(spark, docs, folder)
    assert found.dtypes == spark.createDataFrame([], SCHEMA).dtypes
    return [tuple(r) for r in found.collect()]


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = corpus(random.Random(6))
    folder = str(tmp_path)
    spark.createDataFrame(items, "item_id int, text string").write.parquet(f"{folder}/benchmark.parquet")

    first = kept(cp.identify_language, spark, rows, folder)
    docs = spark.createDataFrame(rows, SCHEMA)
    judged = language.predict(docs, language.train(docs)).collect()
    assert not {r[0] for r in first} & {0, 1, 2}
    assert len(first) == sum(r.lang_pred != "und" and not r.ambiguous for r in judged) > 40
    assert not Counter(first) - Counter(rows)

    second = kept(cp.drop_repeated_lines, spark, first, folder)
    want = brute_lines([r[:2] for r in first])
    left = Counter({(i, text): n for (i, _, _, text), n in want.items()})
    gone = Counter({(i, text): n for (i, _, k, text), n in want.items() if k and not text.split()})
    assert Counter((r[0], r[1]) for r in second) == left - gone and gone
    assert all(r[4] == len(r[1]) or r in rows for r in second)

    third = kept(cp.drop_near_duplicates, spark, second, folder)
    fps = [brute_fingerprint(r[1]) for r in second]
    parent = list(range(len(second)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(second)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(second):
        groups[root(i)].append(r)
    assert len(third) == len(groups) < len(second)
    stays = {(r[0], r[1]) for r in third}
    for group in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in group)
        assert sum((r[0] is None, r[0] or 0) == least and (r[0], r[1]) in stays for r in group) >= 1

    fourth = kept(cp.cut_benchmarks, spark, third, folder)
    hits = {(i, n): hit for i, n, hit, _ in brute_hits([r[:2] for r in third], items, 10)}
    want_words = Counter()
    for r in third:
        w = words(r[1])
        hit = hits[(r[0], len(w))]
        rest = tuple(x for i, x in enumerate(w) if i not in hit)
        if rest:
            want_words[(r[0], rest)] += 1
    assert Counter((r[0], tuple(words(r[1]))) for r in fourth) == want_words
    assert any(hits.values())

    docs = spark.createDataFrame(fourth, SCHEMA)
    fifth = cp.encode(spark, docs, folder).collect()
    assert sorted((str(r.doc_id), r.ids) for r in fifth) == sorted((str(r[0]), brute_ids(r[1])) for r in fourth)
    assert all(r.lossless and r.n_tokens == len(r.ids) for r in fifth)

    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    whole = cp.run(spark, folder).collect()
    assert sorted((str(r.doc_id), r.ids) for r in whole) == sorted((str(r.doc_id), r.ids) for r in fifth)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([(1, "a b")], "item_id int, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0
