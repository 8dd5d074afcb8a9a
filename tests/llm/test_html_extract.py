from __future__ import annotations

import itertools
import random
import time

import pytest

from driftmark.llm import crf
from driftmark.llm import html_extract as he
from driftmark.llm.html_blocks import blocks


@pytest.fixture(scope="module")
def chain():
    return crf.train(he.made_pages())


def path_score(chain, features, labels):
    total = chain.first[labels[0]] + chain.last[labels[-1]]
    total += sum(chain.follows[a][b] for a, b in itertools.pairwise(labels))
    return total + sum(sum(chain.weights.get(n, 0) for n in f) for f, y in zip(features, labels) if y)


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_against_all_paths(seed):
    rng = random.Random(seed)
    r = lambda: rng.uniform(-2, 2)
    chain = crf.Chain({x: r() for x in "abcd"}, [[r(), r()], [r(), r()]], [r(), r()], [r(), r()])
    features = [rng.choices("abcdz", k=rng.randint(0, 3)) for _ in range(rng.randint(1, 8))]
    best = max(itertools.product((0, 1), repeat=len(features)), key=lambda y: path_score(chain, features, y))
    assert path_score(chain, features, chain.decode(features)) == pytest.approx(path_score(chain, features, best))


def test_training_learns_a_chain():
    rng = random.Random(2)
    data = []
    for _ in range(80):
        labels = [0] * rng.randint(1, 5) + [1] * rng.randint(1, 5)
        data.append(([["noise" + str(rng.randint(0, 3))] + (["edge"] if i == 0 else []) for i in range(len(labels))], labels))
    mixed = [([["up"] if rng.random() < 0.9 else ["down"]], [1]) for _ in range(50)] + [([["down"]], [0]) for _ in range(50)]
    chain = crf.train(data + mixed)
    assert chain.weights["up"] > 0 > chain.weights["down"]
    assert chain.follows[1][0] < chain.follows[0][0]  # a 1 is never followed by a 0


def test_made_pages_held_out(chain):
    rng = random.Random(123)
    wrong = total = 0
    for _ in range(200):
        found = blocks(he.made_page(rng))
        total += len(found)
        wrong += sum(y != b.labelled for y, b in zip(chain.decode(he.features_of(found)), found))
    assert wrong < 0.01 * total


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{margin:0}</style><script>var t="</p><p>no</p>";</script>
</head><body class=page><nav><ul><li><a href="/a">Menu</a><li><a href='/b'>More</a></ul></nav><!-- <p>no</p> -->
<div class="ad">Buy this now, it is very cheap and good.</div><div id=cookie-consent><p>We use cookies to make it all better.</p></div>
<article><h1>A &amp;amp; B</h1><p><b>First   bold.<br>line</b> with <a href=x>a link</a> and &lt;tags&gt; &#233;&eacute;&#x1F642;
<p>Second paragraph, which is never closed but long enough to count as a proper one.
<aside>Related: nothing at all here.</aside><p>Third<!-- in --> one.</p><script>no()</script></article>
<section class="comments"><div class=comment><p>I liked this article a lot, thank you.</p></div></section>
<form><label>Name</label><input value=no><textarea>no</textarea></form>
<footer>&copy; example.com &middot; All rights reserved.</footer></body></html>"""


def test_a_page(chain):
    assert he.main_text(PAGE, chain) == (
        "A &amp; B First bold. line with a link and <tags> éé🙂 "
        "Second paragraph, which is never closed but long enough to count as a proper one. Third one."
    )


@pytest.mark.parametrize(
    "page,texts",
    [
        (None, []),
        ("", []),
        ("plain text", ["plain text"]),
        ("a<b>c</b>d", ["acd"]),
        ("<p>a<p>b</div><td>c", ["a", "b", "c"]),
        ("1 < 2 & 3 <br/>x", ["1 < 2 & 3 x"]),
        ("<script>a", []),
        ("<p title='a>b'>x</p><p title='open>y</p>", ["x", "y"]),
        ("<!-- a", []),
        ("<textarea>no</textarea><custom-box>yes</custom-box>", ["yes"]),
        ("<p>a&nbsp;&nbsp;b\t\n c</p>", ["a b c"]),
    ],
)
def test_blocks(page, texts):
    assert [b.text for b in blocks(page)] == texts


def test_extract_table(spark):
    rows = [(1, "u", PAGE, 0), (1, "u", PAGE, 0), (2, None, None, 0), (None, "v", "", 0), (3, "w", f"<article><p>{'Very long text. ' * 30_000}</p></article>", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = {(r.page_id, r.url): r for r in he.extract(pages).collect()}
    assert he.extract(pages, crf.train(he.made_pages(5))).count() == 5
    assert found[(1, "u")].text.startswith("A &amp; B First bold.") and found[(1, "u")].n_chars == len(found[(1, "u")].text)
    assert (found[(2, None)].text, found[(None, "v")].n_chars) == ("", 0)
    assert found[(3, "w")].n_chars == 30_000 * 16 - 1
    assert he.extract(pages.limit(0), crf.train(he.made_pages(5))).count() == 0


def texts(page):
    return [b.text for b in blocks(page)]


def test_no_element_swallows_the_rest_of_the_page():
    for tag in ("object", "noscript", "select", "svg", "math", "iframe", "script", "style", "textarea", "template", "title"):
        assert texts(f"<article><p>before</p><{tag} data=x><p>inside</p><p>after</p></article>") == ["before", "inside", "after"]
    assert texts("<p>a <math><mi>x</mi><mo>=</mo><mn/>1</math> b</p>") == ["a", "x", "=", "1", "b"]
    assert texts("<svg><path d='M0'/><text>label</text></svg><p>b</p>") == ["label", "b"]
    assert texts("<p>a</p><script>no</script><p>b</p><script>x") == ["a", "b"]
    assert texts("<p>a<!-- <p>b") == ["a"] and texts("a <b c") == ["a <b c"]


@pytest.mark.parametrize(
    "page",
    [
        "<a b " * 200_000,
        "<a b " * 200_000 + ">",
        "<a b='" * 170_000,
        '<a "x>"' * 140_000 + "'>",
        "<script>" * 125_000,
        "<!--" * 250_000,
        "<p x=" + "a" * 1_000_000 + ">b",
        "<p " + "x='1' " * 170_000 + ">b",
        "".join(f"<t{i}>" for i in range(130_000)),
        "<div>" * 90_000 + "</x>" * 90_000,
        "&" * 1_000_000,
    ],
    ids=range(11),
)
def test_hostile_pages_take_time_in_proportion(page):
    started = time.process_time()
    blocks(page)
    assert time.process_time() - started < 4
