"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.llm.common import Scratch, ascii_lower, key_of

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS, BATCHES, FANOUT = 40, 5, 4, 4
KEY = ("hi", "lo")


def line_key(line: Column) -> Column:
    """A line without the blanks at its ends, A-Z in lower case."""
    return F.btrim(line, F.lit(BLANKS))


def _folded(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def batch_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows ``(doc_id, hi, lo)``: hashes of the keys of a batch that are long enough. The text is
    folded once before it is split; blanks are stripped line by line."""
    lines = docs.select("doc_id", F.explode(F.split(_folded(F.col("text")), "\n")).alias("line"))
    keys = lines.where(F.char_length("line") >= min_chars).select("doc_id", line_key(F.col("line")).alias("key"))
    keys = keys.where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", *[h.alias(n) for n, h in zip(KEY, key_of(F.col("key")))])


class LineRuns:
    """Sorted runs of ``(hi, lo, n_docs, last_doc)`` in levels.

    ``add`` writes a batch as a run of level 0: one row for each key with the number of the batch's
    documents that have it and the largest of them. When a level holds ``fanout`` runs they are
    merged into one of the next level, so a key is rewritten a number of times that grows with the
    logarithm of the number of batches. Batches must not share a document.
    """

    def __init__(self, scratch: Scratch, *, fanout: int = FANOUT):
        self.scratch, self.fanout = scratch, fanout
        self.levels: list[list[str]] = []
        self._written = 0

    def _write(self, level: int, run: DataFrame) -> None:
        name = f"run-{level}-{self._written}"
        self._written += 1
        self.scratch.settle(name, run.sortWithinPartitions(*KEY))
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _read(self, names: list[str]) -> DataFrame:
        schema = "hi long, lo long, n_docs long, last_doc long"
        return self.scratch.spark.read.schema(schema).parquet(*[self.scratch.path(n) for n in names])

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))

    def add(self, lines: DataFrame) -> None:
        """Add a batch of rows ``(doc_id, hi, lo)``; a key may repeat within a document."""
        once = lines.groupBy(*KEY, "doc_id").agg(F.lit(1).alias("one"))
        run = once.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        self._write(0, run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            names, self.levels[level] = self.levels[level], []
            self._write(level + 1, self._merged(self._read(names)))
            self.scratch.drop(*names)
            level += 1

    def keys(self) -> DataFrame:
        """All keys with their totals over the runs."""
        names = [n for level in self.levels for n in level]
        if not names:
            return self.scratch.spark.createDataFrame([], "hi long, lo long, n_docs long, last_doc long")
        return self._merged(self._read(names))

    def unseen(self, lines: DataFrame) -> DataFrame:
        """Lines of a new batch that no run holds: a merge-anti-join on the key."""
        names = [n for level in self.levels for n in level]
        return lines.join(self._read(names), list(KEY), "left_anti") if names else lines


def build_runs(
    docs: DataFrame, scratch: Scratch, *, min_chars: int = MIN_CHARS, batches: int = BATCHES, fanout: int = FANOUT
) -> LineRuns:
    """Runs over all documents, added in batches dealt by the hash of doc_id."""
    runs = LineRuns(scratch, fanout=fanout)
    for n in range(batches):
        mine = F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == n
        runs.add(batch_lines(docs.where(mine), min_chars))
    return runs


def dedup_lines(
    docs: DataFrame,
    *,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
    keep: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Rows ``(*keep, n_lines, n_dropped, kept)`` for each row of ``docs (doc_id, text)``.

    A text is split at \\n; a null or empty one is one empty line. A key of at least ``min_chars``
    code points found in at least ``min_docs`` documents loses all its lines but those of the
    largest doc_id that has it. The other lines stay as they are, joined by \\n. Rows that repeat a
    doc_id count as one document and are each answered; a null doc_id counts as no document, and
    loses the lines that others lose. An empty table gives no rows; other columns are ignored.
    """
    docs = docs.select(*dict.fromkeys(["doc_id", "text", *keep]))
    scratch = Scratch(docs.sparkSession, "lines")
    runs = build_runs(docs.where("doc_id is not null"), scratch, min_chars=min_chars, batches=batches, fanout=fanout)
    hot = scratch.settle("hot", runs.keys().where(F.col("n_docs") >= min_docs))
    # Lines that lose: their key is hot and a larger document has it. A key stands alone on the
    # side of the runs, so a line that a third of the documents share is split by the skew join.
    lines = batch_lines(docs, min_chars)
    lost = lines.join(hot, list(KEY)).where("doc_id is null or doc_id <> last_doc")
    per_doc = lost.groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_set(F.struct(*KEY)).alias("lost"))
    per_doc = scratch.settle("lost", per_doc)
    # Merged at every size: a broadcast that holds for small tables alone would change the plan.
    rows = docs.join(per_doc.hint("merge"), docs.doc_id.eqNullSafe(per_doc.lost_id), "left")
    whole = F.coalesce("text", F.lit(""))

    def keeps(line: Column) -> Column:
        key = line_key(ascii_lower(line))
        return (F.char_length(key) < min_chars) | ~F.array_contains(
            F.col("lost"), F.struct(*[h.alias(n) for n, h in zip(KEY, key_of(key))])
        )

    rows = rows.select(
        *keep,
        F.split(whole, "\n").alias("lines"),
        whole.alias("whole"),
        F.when(F.col("lost").isNotNull(), F.filter(F.split(whole, "\n"), keeps)).alias("left"),
    )
    return rows.select(
        *keep,
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join("left", "\n"), F.col("whole")).alias("kept"),
    )
