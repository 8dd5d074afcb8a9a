"""Main text of web pages: a conditional random field labels the blocks of each page."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm import crf
from driftmark.llm.html_blocks import LABEL, Block, blocks

# Bounds of what training reads: pages of the table, their length, and made pages.
SAMPLE_PAGES, SAMPLE_CHARS, MADE_PAGES = 200, 50_000, 300


def features_of(found: list[Block]) -> crf.Features:
    """Features of each block: its ancestors, its tag, and how its text looks. None names a language."""
    out = []
    for i, block in enumerate(found):
        text, n = block.text, len(block.text)
        names = list(block.around)
        names.append(f"tag:{block.tag}")
        names.append("long" if n > 200 else "middle" if n > 60 else "short")
        if block.linked > 0.5:
            names.append("linked")
        if text[-1] in ".!?:;\"'”»…":
            names.append("sentence")
        if text[0] in "©" or "©" in text[:40]:
            names.append("copyright")
        if i == 0:
            names.append("begin")
        if i == len(found) - 1:
            names.append("end")
        out.append(names)
    return out


# --- labelled pages ------------------------------------------------------------------------------

_AROUND = ("nav", "aside", "footer", "header", "form", "dialog", "menu", "select", "noscript", "svg")
_AROUND_KEYS = ("nav", "foot", "side", "ad", "notice", "form", "comment", "hidden", "head")


def silver_labels(found: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article with <article> or <main>: what is inside and not in a
    part that such elements hold besides their text. None for a page without such a mark."""
    inside = [bool({"in:article", "in:main"} & b.around) for b in found]
    if not any(inside):
        return None
    other = {f"in:{t}" for t in _AROUND} | {f"key:{k}" for k in _AROUND_KEYS}
    return [int(x and not other & b.around) for x, b in zip(inside, found)]


def made_page(rng: random.Random) -> str:
    """A made page whose main blocks carry the label, with boilerplate of many kinds around and in it."""

    def words(a: int, b: int) -> str:
        letters = "etaoinsrhldcumfpg"
        return " ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentence(a: int, b: int) -> str:
        return words(a, b).capitalize() + rng.choice("...!?")

    def items(n: int) -> str:
        return "<ul>" + "".join(f"<li><a href='/x'>{words(1, 3)}</a></li>" for _ in range(n)) + "</ul>"

    def named(tag: str, names: str, inner: str) -> str:
        how = rng.choice(("class", "id", "role" if rng.random() < 0.2 else "class"))
        name = rng.choice(names.split())
        return f"<{tag} {how}='{rng.choice(('', 'site-', 'main-', 'page '))}{name}'>{inner}</{tag}>"

    def junk() -> str:
        return rng.choice(
            (
                lambda: f"<nav>{items(5)}</nav>",
                lambda: named("div", "menu navbar breadcrumbs pagination", items(4)),
                lambda: f"<header><h1>{words(1, 4)}</h1><p>{sentence(3, 9)}</p></header>",
                lambda: named("div", "header masthead topbar", f"<p>{words(1, 8)}</p>"),
                lambda: f"<aside><h3>{words(1, 3)}</h3><p>{sentence(8, 60)}</p>{items(3)}</aside>",
                lambda: named("div", "sidebar widget related popular share", f"<h3>{words(1, 3)}</h3><p>{sentence(5, 50)}</p>"),
                lambda: named("div", "ad ads advert advertisement sponsored promo", rng.choice((sentence(4, 40), f"<p>{sentence(4, 40)}</p>"))),
                lambda: named("div", "cookie-consent notice newsletter popup banner gdpr", f"<p>{sentence(8, 40)}</p><button>{words(1, 2)}</button>"),
                lambda: f"<form><label>{words(1, 3)}</label><input><p>{sentence(3, 12)}</p><button>{words(1, 2)}</button></form>",
                lambda: named("div", "login search signup", f"<p>{sentence(2, 9)}</p>"),
                lambda: named("section", "comments discussion replies", "".join(f"<div class='comment'><p>{sentence(5, 60)}</p></div>" for _ in range(3))),
                lambda: f"<footer><p>&copy; {words(2, 6)}</p><p>{sentence(4, 30)}</p></footer>",
                lambda: named("div", "footer copyright legal", rng.choice((f"&copy; {words(3, 9)}", sentence(5, 30)))),
                lambda: f"<dialog>{sentence(4, 20)}</dialog>",
                lambda: "<select>" + "".join(f"<option>{words(1, 3)}</option>" for _ in range(3)) + "</select>",
                lambda: f"<noscript><p>{sentence(3, 20)}</p></noscript>",
                lambda: f"<svg><text>{words(1, 4)}</text></svg>",
                lambda: f"<div hidden>{sentence(4, 40)}</div>",
            )
        )()

    def main() -> str:
        body = [f"<h1 {LABEL}>{words(2, 9)}</h1>"] if rng.random() < 0.8 else []
        for _ in range(rng.randint(1, 9)):
            kind = rng.random()
            if kind < 0.7:
                body.append(f"<p {LABEL}>{rng.choice((sentence(1, 9), sentence(10, 90), words(4, 40)))}</p>")
            elif kind < 0.8:
                body.append(f"<h2 {LABEL}>{words(1, 6)}</h2>")
            elif kind < 0.87:
                body.append(f"<ul {LABEL}>" + "".join(f"<li>{sentence(2, 20)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.93:
                body.append(f"<blockquote {LABEL}>{sentence(5, 40)}</blockquote>")
            else:
                body.append(junk())
        if rng.random() < 0.3:
            body.append(junk())
        inner = "".join(body)
        return rng.choice(
            (
                f"<article>{inner}</article>",
                f"<main>{inner}</main>",
                f"<main><article>{inner}</article></main>",
                f"<div class='{rng.choice(('content', 'post-body', 'entry', 'story', 'main'))}'>{inner}</div>",
                f"<div>{inner}</div>",
                f"<section>{inner}</section>",
            )
        )

    before, after = ("".join(junk() for _ in range(rng.randint(0, 4))) for _ in range(2))
    return f"<html><body>{before}{main()}{after}</body></html>"


def made_pages(n: int = MADE_PAGES) -> list[tuple[crf.Features, list[int]]]:
    rng = random.Random(17)
    found = [blocks(made_page(rng)) for _ in range(n)]
    return [(features_of(b), [int(x.labelled) for x in b]) for b in found]


def train(pages: DataFrame, *, sample_pages: int = SAMPLE_PAGES, sample_chars: int = SAMPLE_CHARS) -> crf.Chain:
    """A chain learnt from made pages with labels and from at most ``sample_pages`` pages of the
    table, of at most ``sample_chars`` characters, that mark their article. The sample is the first
    by a hash of page_id, whatever the partitioning; where few pages carry marks it is smaller."""
    marked = pages.where(F.col("html").rlike(r"(?i)<(article|main)[\s>]") & (F.char_length("html") <= sample_chars))
    hashes = {"h1": F.xxhash64("page_id"), "h2": F.xxhash64("html")}
    labelled = made_pages()
    # The hashes are chosen first, so that tasks send whole pages only of the sample.
    first = marked.select(*[h.alias(n) for n, h in hashes.items()]).orderBy("h1", "h2").limit(sample_pages).collect() if sample_pages else []
    sample = marked.withColumns(hashes).where(F.col("h1").isin([r.h1 for r in first]) & F.col("h2").isin([r.h2 for r in first]))
    for row in sample.orderBy("h1", "h2").limit(sample_pages).select("html").collect() if first else []:
        found = blocks(row.html)
        if (labels := silver_labels(found)) is not None:
            labelled.append((features_of(found), labels))
    return crf.train(labelled)


def main_text(page: str | None, chain: crf.Chain) -> str:
    found = blocks(page)
    return " ".join(b.text for b, main in zip(found, chain.decode(features_of(found))) if main)


def extract(pages: DataFrame, chain: crf.Chain | None = None) -> DataFrame:
    """Rows ``(page_id, url, text, n_chars)`` for each row of ``pages (page_id, url, html)``.

    The main blocks in page order, each with its white space made one, joined by one space; n_chars
    counts code points. Null and empty pages, and pages without a main block, give an empty text.
    Null ids and urls and repeated rows are answered as they are; an empty table gives no rows; other
    columns are ignored. A page is parsed whole, one after the other.
    """
    chain = chain or train(pages)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py(), chain) for p in batch.column(2)]
            columns = [*batch.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(
        extracted, f"page_id {kind}, url string, text string, n_chars long"
    )
