"""Quality rules as a ledger of failure bits, judged by versioned policies."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_exclaims",
    "n_bare_words",
)
# Words without a letter; every character beyond ASCII counts as a letter.
_BARE = re.compile(rb"(?<!\S)[^\sA-Za-z\x80-\xff]+(?!\S)")


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of ``MEASURES``; a null text has no words.
    Works on UTF-8 bytes, whose white space is exactly the blanks that part words."""
    raw = (text or "").encode()
    words = raw.split()
    n = len(words)
    chars = len(text or "") - sum(raw.count(b) for b in BLANKS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:]))
    first: dict[tuple[bytes, bytes, bytes], int] = {}
    if len(set(windows)) < len(windows):
        hit = bytearray(n)
        for i, window in enumerate(windows):
            j = first.setdefault(window, i)
            if j != i:
                hit[j : j + 3] = hit[i : i + 3] = b"\1\1\1"
        repeated = sum(hit)
    return (
        n,
        chars,
        sum(raw.count(b) for b in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        raw.count(b"!"),
        len(_BARE.findall(raw)),
    )


@dataclass(frozen=True)
class QualityRule:
    """A rule that fails where its SQL condition over the measurements holds."""

    bit: int
    name: str
    fails: str


RULES = (
    QualityRule(0, "few_words", "n_words < 50"),
    QualityRule(1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    QualityRule(2, "symbols", "10 * n_symbols > n_words"),
    QualityRule(3, "repeated_lines", "100 * n_dup_lines > 30 * n_lines"),
    QualityRule(4, "short_words", "word_chars < 3 * n_words"),
    QualityRule(5, "long_words", "word_chars > 12 * n_words"),
    QualityRule(6, "many_words", "n_words > 100000"),
    QualityRule(7, "exclaims", "100 * n_exclaims > 30 * n_words"),
    QualityRule(8, "bare_words", "100 * n_bare_words > 20 * n_words"),
)
BASE = ("few_words", "repeated_windows")
# Rules that reject, by version of the policy. A version never changes once it was used.
POLICIES: dict[int, tuple[str, ...]] = {
    1: BASE,
    2: (*BASE, "symbols", "repeated_lines", "short_words", "long_words", "many_words", "exclaims", "bare_words"),
}
CURRENT_POLICY = 2


def mask_of(names: tuple[str, ...], rules: tuple[QualityRule, ...] = RULES) -> int:
    return sum(1 << r.bit for r in rules if r.name in names)


def ledger(docs: DataFrame, rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """One row for each row of ``docs (doc_id, text)``: doc_id, the measurements, failure_bits.

    Every rule is evaluated once; policies only read the bits. Null and empty texts measure zero
    (and so fail ``few_words`` alone), null and repeated doc_ids are kept as they are, an empty
    table gives no rows, other columns are ignored. Texts are measured whole, one at a time.
    """
    schema = ", ".join(["doc_id " + dict(docs.dtypes)["doc_id"], *(f"{m} long" for m in MEASURES)])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(text.as_py()) for text in batch.column(1)]
            columns = [pa.array(c, pa.int64()) for c in zip(*found)] or [pa.array([], pa.int64())] * len(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", *MEASURES])

    rows = docs.select("doc_id", "text").mapInArrow(measured, schema)
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long"))
    return rows.withColumn("failure_bits", bits)


def judge(rows: DataFrame, version: int = CURRENT_POLICY, rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """A ledger with ``base_failed`` and the policy's verdict ``kept``."""
    failed = F.col("failure_bits")
    return rows.withColumns(
        {
            "base_failed": failed.bitwiseAND(F.lit(mask_of(BASE, rules))) != 0,
            "kept": failed.bitwiseAND(F.lit(mask_of((*BASE, *POLICIES[version]), rules))) == 0,
        }
    )


def ablation(rows: DataFrame, version: int = CURRENT_POLICY, rules: tuple[QualityRule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, and those that it alone rejects, which
    come back when it is left out. The ledger is first counted by its bits (at most two to the
    number of rules), so nothing larger is shuffled or read again."""
    names = POLICIES[version]
    counted = rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask_of(names, rules))).alias("bits"))
    counted = counted.agg(F.count("*").alias("n"))
    mine = [r for r in rules if r.name in names]
    each = F.explode(F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in mine]))
    counted = counted.select("bits", "n", each.alias("r")).select("bits", "n", "r.*")
    fails = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return counted.groupBy("rule").agg(
        F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_alone"),
    )
