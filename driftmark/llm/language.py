"""Language identification with error-correcting output codes over character n-grams.

Every language has a codeword; each bit of it splits the languages in two, and a binary n-gram
classifier predicts that bit. The word whose weighted loss against all predicted bits is smallest
names the language, so that single wrong bits are corrected.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import slices, small_batches

ORDERS = (2, 3, 4)
BUCKET_BITS = 14
SIZE = len(ORDERS) << BUCKET_BITS
# The model holds a weight for each bucket and bit, so the number of languages has a bound.
MAX_LANGUAGES = 64
# Bytes whose n-grams are held at once.
PIECE = 1 << 18
# Relative lead over the second language under which a prediction counts as ambiguous.
AMBIGUOUS = 0.02
UNKNOWN = "und"
# A-Z in lower case; other ASCII is a blank; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def has_letter(text):
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def codewords(n: int) -> np.ndarray:
    """A matrix of 1 and -1 with a row for each of ``n`` languages: all ways to part them for up to
    seven, else the columns of a Hadamard matrix, in which any two rows differ in half the bits."""
    if n <= 7:
        splits = range(1, (1 << n) // 2)
        return np.array([[-1 if s >> i & 1 else 1 for s in splits] for i in range(n)], np.int8).reshape(n, len(splits))
    rows = np.ones((1, 1), np.int8)
    while len(rows) < n + 1:
        rows = np.block([[rows, rows], [rows, -rows]])
    return rows[1 : n + 1, 1:]


def grams(folded: np.ndarray, ends: np.ndarray, laps: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams, a row for each order, at the byte where they begin. Those that would
    reach past the end of their part, or begin in its last ``laps`` bytes, which the next part
    begins with, go to the bucket ``SIZE``."""
    n = len(folded)
    out = np.full((len(ORDERS), n), SIZE, np.int32)
    wide = np.zeros(n + max(ORDERS), np.uint32)
    wide[:n] = folded
    starts = np.concatenate(([0], ends[:-1]))
    for row, order in enumerate(ORDERS):
        code = np.zeros(n, np.uint32)
        for i in range(order):
            code |= wide[i : i + n] << np.uint32(8 * i)
        out[row] = (code * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32) + (row << BUCKET_BITS)
        for back in range(1, order):
            at = ends - back
            out[row, at[at >= starts]] = SIZE
    for back in range(1, int(laps.max(initial=0)) + 1):
        out[:, ends[laps >= back] - back] = SIZE
    return out


def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of the texts, their bytes, their ends, their laps) in pieces of about ``PIECE``
    bytes. A longer text comes in several parts; each but the last goes on for a lap, so that it
    holds the n-grams that begin in it."""
    lap = max(ORDERS) - 1
    which: list[int] = []
    parts: list[bytes] = []
    laps: list[int] = []
    size = 0

    def piece():
        ends = np.cumsum([len(p) for p in parts])
        return np.array(which), np.frombuffer(b"".join(parts), np.uint8), ends, np.array(laps)

    for i, text in enumerate(texts):
        for at in range(0, len(text), PIECE):
            which.append(i)
            parts.append(text[at : at + PIECE + lap])
            laps.append(max(0, len(parts[-1]) - PIECE))
            size += len(parts[-1])
            if size >= PIECE:
                yield piece()
                which, parts, laps, size = [], [], [], 0
    if parts:
        yield piece()


def _folded(texts: pa.Array) -> list[bytes]:
    return [t.as_py().encode().translate(_FOLD) for t in texts]


def gram_counts(labelled: DataFrame) -> DataFrame:
    """Rows ``(lang, bucket, n)`` over all rows of ``labelled (lang, text)``. A task adds up what it
    reads and gives each language's buckets once, so the shuffle grows with the number of tasks."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            names = sorted(set(langs))
            number = {name: i for i, name in enumerate(names)}
            of_text = np.array([number[x] for x in langs], np.int64)
            found = np.zeros((len(names), SIZE + 1), np.int64)
            for which, folded, ends, laps in _pieces(_folded(batch.column(1))):
                lang = np.repeat(of_text[which], np.diff(np.concatenate(([0], ends))))
                for row in grams(folded, ends, laps):
                    found += np.bincount(lang * (SIZE + 1) + row, minlength=found.size).reshape(found.shape)
            for name, i in number.items():
                totals[name] = totals.get(name, 0) + found[i, :SIZE]
        for name, total in totals.items():
            seen = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(seen), pa.string()), pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())],
                ["lang", "bucket", "n"],
            )

    found = labelled.select("lang", "text").mapInArrow(counted, "lang string, bucket long, n long")
    return found.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Weights of the bit classifiers for each bucket, and what decoding needs."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    trust: np.ndarray

    @classmethod
    def of(cls, counts: dict[str, np.ndarray]) -> Model:
        """Each bit's classifier is a naive Bayes one: the log odds of an n-gram between the two
        sides of the split, every language of a side counting alike. A bit's trust for a language
        is the mean log odds that the language's own n-grams give, so a bit that hardly tells it
        from the other side weighs little."""
        languages = sorted(counts)
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        code = codewords(len(languages))
        if len(languages) < 2:
            return cls(languages, code, np.zeros((SIZE + 1, 0), np.float32), np.zeros(code.shape))
        share = np.array([counts[x] for x in languages], np.float64).reshape(len(languages), len(ORDERS), -1) + 0.5
        share = (share / share.sum(axis=2, keepdims=True)).reshape(len(languages), SIZE)
        weights = np.zeros((SIZE + 1, code.shape[1]))
        for j, column in enumerate(code.T):
            weights[:SIZE, j] = np.log(share[column > 0].mean(axis=0) / share[column < 0].mean(axis=0))
        trust = np.abs(share @ weights[:SIZE]) / len(ORDERS)
        weights /= np.maximum(trust.mean(axis=0), 1e-9)
        trust /= np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
        return cls(languages, code, weights.astype(np.float32), trust)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Mean log odds of every text's n-grams for every bit; about 1 or -1 for plain text."""
        total = np.zeros((len(texts), self.code.shape[1]))
        seen = np.zeros(len(texts))
        for which, folded, ends, laps in _pieces(texts):
            starts = np.concatenate(([0], ends[:-1]))
            for row in grams(folded, ends, laps):
                total_here = np.add.reduceat(self.weights[row], starts, axis=0, dtype=np.float64)
                np.add.at(total, which, total_here)
                np.add.at(seen, which, np.add.reduceat((row != SIZE).astype(np.int64), starts))
        return total / np.maximum(seen, 1)[:, None]

    def decode(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the language with the smallest weighted loss, and its lead over the second one,
        from 0 to 1. Of equal losses the first language in alphabetical order is taken."""
        if len(self.languages) < 2:
            return np.zeros(len(bits), np.int64), np.ones(len(bits))
        agree = np.clip(self.code[None].astype(np.float64) * bits[:, None], -20, 20)
        loss = (self.trust[None] * np.exp(-agree)).sum(axis=2)
        best = loss.argmin(axis=1)
        two = np.partition(loss, 1, axis=1)[:, :2]
        return best, (two[:, 1] - two[:, 0]) / (two[:, 1] + two[:, 0])


def train(labelled: DataFrame) -> Model:
    """A model from all rows of ``labelled (lang, text)`` with a language and a letter. What comes to
    the driver are sums: at most the number of languages times ``SIZE`` numbers."""
    labelled = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts: dict[str, np.ndarray] = {}
    by_language = gram_counts(labelled).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"))
    with small_batches(labelled.sparkSession):
        for row in by_language.toLocalIterator():
            total = counts.setdefault(row.lang, np.zeros(SIZE, np.int64))
            total[list(row.m)] = list(row.m.values())
    return Model.of(counts)


def predict(docs: DataFrame, model: Model, *, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Rows ``(*keep, lang_pred, score, ambiguous)`` for each row of ``docs (*keep, text)``.

    The prediction comes from the whole text alone. A text that is null or has no letter, and any
    text where nothing was learned, is ``und`` with score 0. ``ambiguous`` marks a lead of less than
    ``AMBIGUOUS``. Repeated rows and null ids are answered each; an empty table gives no rows; other
    columns are ignored.
    """
    names = np.array([*model.languages, UNKNOWN], object)

    # The text travels once, whether it is kept or not.
    sent = list(keep) if "text" in keep else [*keep, "text"]
    at = sent.index("text")

    def predicted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = pc.fill_null(pc.binary_length(whole.column(at)), 0).to_pylist()
            for a, b in slices(sizes):
                batch = whole.slice(a, b - a)
                text, has = batch.column(at), batch.column(len(sent))
                known = np.array(has.to_pylist(), bool) if model.languages else np.zeros(batch.num_rows, bool)
                best, score = np.full(batch.num_rows, len(model.languages)), np.zeros(batch.num_rows)
                if known.any():
                    best[known], score[known] = model.decode(model.bits(_folded(text.filter(pa.array(known)))))
                columns = [*batch.columns[: len(keep)], pa.array(names[best], pa.string()), pa.array(score)]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    rows = docs.select(*sent, has_letter(F.col("text")).alias("_known"))
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string", "score double"])
    found = rows.mapInArrow(predicted, schema)
    return found.withColumn("ambiguous", (F.col("lang_pred") != UNKNOWN) & (F.col("score") < AMBIGUOUS))


def held_out(doc_id):
    """Documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def identify(docs: DataFrame) -> DataFrame:
    """Learn from the documents that aren't held out and predict all: ``predict``'s columns and
    ``held_out``. A null doc_id counts as held out."""
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).withColumn("held_out", held_out(F.col("doc_id")))
