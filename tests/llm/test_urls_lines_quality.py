from __future__ import annotations

import re
import time
from collections import Counter, defaultdict

from driftmark.llm import line_dedup, quality, url_filter
from driftmark.llm.common import Scratch, components
from driftmark.llm.queries import URL_RULES
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None):
    rows = [(i, t, "x", "y") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, hi string")


# --- components and urls -------------------------------------------------------------------------


def test_components_against_union_find(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7), (None, 3), (300, 100), (500, 501), (500, 501)]
    links += [(1000, 1000 + k) for k in range(1, 300)]
    found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"))
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert {r.node: r.component for r in found.collect()} == {x: root(x) for x in parent}
    assert found.count() == len(parent)


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a string, b string"), Scratch(spark, "t")).count() == 0


def page(*heads):
    return f"<html><head>{''.join(heads)}</head><body>x</body></html>"


def canonical(href):
    return f'<link href="{href}" rel="canonical">'


def test_urls_rules_and_aliases(spark):
    rows = [
        (1, "https://Blog.Example.NET/x", page()),  # blocked by net/
        (2, "https://blog.example.net/en/1#top", page()),  # the longer allow wins
        (3, "http://a.org/y?q=1#z", page(canonical("https://blog.example.net/x"))),  # alias of a blocked one
        (4, "http://a.org/fr/y", page(canonical("http://a.org/y?q=1"))),  # explicit allow beats the alias
        (5, "http://b.org/k/1", page('<META HTTP-EQUIV=Refresh CONTENT="0; URL=2">')),  # relative redirect
        (6, "http://b.org/k/2", page(canonical("//c.example.com/de/1"))),  # blocked target that wasn't crawled
        (7, "http://d.org/1", page("<!-- " + canonical("http://x.net/") + " -->", "<script>'" + canonical("http://x.net/") + "'</script>")),
        (8, None, page(canonical("http://x.net/"))),
        (9, "no address", None),
        (10, "http://net", None),  # its path doesn't start with /
        (11, "ftp://other.net:80?x/", None),
        (12, "http://e.org/1", page(canonical("/2&amp;3"))),
        (12, "http://e.org/1", page(canonical("/2&amp;3"))),
        (None, "http://notexample.com/de/", page()),
    ]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, component string")
    found = url_filter.judge(pages, URL_RULES)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in found.collect())
    assert got == Counter(
        [
            (1, "blog.example.net", "/x", "net/", "block"),
            (2, "blog.example.net", "/en/1", "example.net/en/", "allow"),
            (3, "a.org", "/y", None, "block"),
            (4, "a.org", "/fr/y", "org/fr/", "allow"),
            (5, "b.org", "/k/1", None, "block"),
            (6, "b.org", "/k/2", None, "block"),
            (7, "d.org", "/1", None, "allow"),
            (8, "", "", None, "allow"),
            (9, "", "", None, "allow"),
            (10, "net", "", None, "allow"),
            (11, "other.net:80", "", None, "allow"),
            (12, "e.org", "/1", None, "allow"),
            (12, "e.org", "/1", None, "allow"),
            (None, "notexample.com", "/de/", None, "allow"),
        ]
    )
    assert url_filter.judge(pages.limit(0), URL_RULES).count() == 0


# --- lines ---------------------------------------------------------------------------------------


def brute_lines(rows, min_chars=40, min_docs=5):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line)

    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and i is not None:
                holders[key(line)].add(i)
    out = Counter()
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(h := holders.get(key(x), set())) < min_docs or i == max(h)]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


LONG = "É this line is just long enough to be counted, ok"


def test_lines_against_brute_force(spark):
    rows = [(i, f"own {i}\n  {LONG if i % 2 else LONG.upper().replace('É', 'É')} \t\r\nend") for i in range(7)]
    rows += [(i, "short line\n" * 3 + LONG.replace("É", "é")) for i in range(20, 24)]
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, f"{LONG}\n{LONG}\n"), (33, f"{LONG}\n{LONG}\n"), (None, LONG), (34, "y" * 200_000)]
    rows += [(40 + i, "x" * 40 + "\n" + "z" * 39 + "\n" + "🙂" * 40) for i in range(5)]
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    want = brute_lines(rows)
    for batches, fanout in ((4, 4), (5, 2), (1, 4)):
        found = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
        assert Counter(tuple(r) for r in found.collect()) == want
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_line_runs_compact_and_find_unseen(spark):
    runs = line_dedup.LineRuns(Scratch(spark, "t"), fanout=2)
    for i in range(5):
        batch = docs_of(spark, [f"{LONG} {j}" for j in range(i, i + 3)], [10 * i + j for j in range(3)])
        lines = line_dedup.batch_lines(batch, 40)
        assert runs.unseen(lines).count() == (3 if i == 0 else 1)
        runs.add(lines)
    assert [len(level) for level in runs.levels] == [1, 0, 1]
    assert sorted(r.n_docs for r in runs.keys().collect()) == [1, 1, 2, 2, 3, 3, 3]


def test_lines_plan_is_native(spark, capsys):
    docs = docs_of(spark, ["a"])
    line_dedup.dedup_lines(docs).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# --- quality -------------------------------------------------------------------------------------


def brute_measures(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + o for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for o in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), len(lines),
        text.count("!"), sum(not re.search(r"[A-Za-z]|[^\x00-\x7f]", w) for w in words),
    )


TEXTS = [
    None, "", "a b c a b c", "x\x85y z w \x1c q", "line\nline\n \nline\n", "é#* | 12 34% & <b>!!\x0b\x0c\r\t", "w " * 60,
    " ".join(f"word{i}" for i in range(80)), "go go go", "a b a b a b", "### " * 70 + " ".join(f"w{i}" for i in range(30)), "q" * 50_000,
]


def test_measures_against_brute_force(spark):
    assert [quality.measure(t) for t in TEXTS] == [brute_measures(t) for t in TEXTS]
    rows = quality.judge(quality.ledger(docs_of(spark, TEXTS))).collect()
    assert [tuple(r[m] for m in quality.MEASURES) for r in sorted(rows, key=lambda r: r.doc_id)] == [brute_measures(t) for t in TEXTS]
    by_id = {r.doc_id: r for r in rows}
    assert by_id[7].kept and not by_id[7].base_failed and by_id[7].failure_bits == 0
    assert not by_id[0].kept and by_id[0].failure_bits == 1
    assert by_id[10].failure_bits & 4


def test_policies_and_ablation(spark):
    rows = quality.ledger(docs_of(spark, TEXTS))
    bits = [r.failure_bits for r in rows.collect()]
    for version, names in quality.POLICIES.items():
        mask = quality.mask_of(names)
        got = {r.rule: (r.n_failed, r.n_alone) for r in quality.ablation(rows, version).collect()}
        want = {r.name: (sum(bool(b & 1 << r.bit) for b in bits), sum(b & mask == 1 << r.bit for b in bits)) for r in quality.RULES if r.name in names}
        assert got == want
    assert quality.judge(quality.ledger(docs_of(spark, []))).count() == 0


# --- addresses of aliases ------------------------------------------------------------------------


def test_alias_targets_are_resolved(spark):
    cases = {
        ("http://a.org/b/c", "../x"): "http://a.org/x",
        ("http://a.org/b/c", "./x/../y/."): "http://a.org/b/y/",
        ("http://a.org/b/c", "/../../x?q=../z#../f"): "http://a.org/x?q=../z#../f",
        ("http://a.org/b/c/", ".."): "http://a.org/b/",
        ("http://a.org/p/x?id=1", "?id=2"): "http://a.org/p/x?id=2",
        ("http://a.org/p/x?id=1", "#f"): "http://a.org/p/x?id=1#f",
        ("http://a.org", "x"): "http://a.org/x",
        ("http://a.org/p", "//b.org/./y"): "http://b.org/y",
        ("http://a.org/p", "http://b.org/a/../y..z/..w"): "http://b.org/y..z/..w",
        ("http://a.org/p", "http://b.org"): "http://b.org",
    }
    rows = spark.createDataFrame([(u, t, w) for (u, t), w in cases.items()], "url string, target string, want string")
    found = rows.select("url", "target", "want", url_filter.resolve(F.col("target"), F.col("url")).alias("got")).collect()
    assert [(r.url, r.target, r.got) for r in found] == [(r.url, r.target, r.want) for r in found]


def test_blocks_reach_aliases_with_relative_targets(spark):
    rules = [("block", "a.org", "/bad")]
    rows = [
        (1, "http://x.org/q/1", page(canonical("http://a.org/n/../bad/1"))),
        (2, "http://x.org/q/2", page('<base href="http://a.org/bad/k/">', canonical("../2"))),
        (3, "http://x.org/q/3", page(canonical("http:&#x2F;&#47;a.org&sol;bad?a=1&amp;b=2"))),
        (4, "http://x.org/q/4?id=1", page(canonical("?id=2"))),
        (5, "http://x.org/q/4?id=2", page(canonical("http://a.org/bad/4"))),
        (6, "http://x.org/q/6", page("<base target=_top>", '<base href="/n/">', canonical("7"))),
        (7, "http://x.org/n/7", page(canonical("http://a.org/bad/7"))),
        (8, "http://x.org/q/8", page("<!-- <base href='http://a.org/bad/'> -->", canonical("9"))),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in url_filter.judge(pages, rules).collect()}
    assert found == {i: "block" if i < 8 else "allow" for i in range(1, 9)}


def test_long_tags_are_read(spark):
    """A tag of a megabyte costs no stack, and one that never closes no repeated search."""
    mb = 1_000_000
    heads = [
        f"<link rel=canonical href=/{'a' * mb}>",
        f'<link rel="canonical" href="/{"b" * mb}">',
        "<link rel=canonical " + "x='1' " * 170_000 + "href=/c>",
        "<link rel=canonical href=/d><meta " + "e" * mb,
        "<link rel=canonical href=/e>" + "<meta refresh " * 70_000,
        "<link rel=canonical href=/f>" + "<!--" * 250_000,
        "<link rel=canonical href=/g>" + "<script " * 125_000,
    ]
    pages = spark.createDataFrame([(f"http://h.org/{i}", h) for i, h in enumerate(heads)], "url string, html string")
    started = time.monotonic()
    links = url_filter.alias_links(pages, Scratch(spark, "t")).collect()
    assert time.monotonic() - started < 60
    assert {r.b[:8] for r in links} == {f"h.org/{c}" + ("a" if c == "a" else "b" if c == "b" else "") for c in "abcdefg"}
