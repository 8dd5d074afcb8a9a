"""How filters interact: what each removes at every place of every order, and its Shapley share.

Which filters a document fails is a mask of bits, and all that matters of a corpus is how many
documents have each mask. A filter applied after a set of others is an edge of the subset lattice,
from that set to the set with it. Counting the orders that reach an edge's start (forward) and that
leave its end (backward) tells how many orders use the edge: a filter's removals over all orders are
its edges' removals weighted by that, and the steps of a single order are read from the same edges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from driftmark.llm.common import Scratch, key_of
from driftmark.operators.joins import skew_join

BLANKS = r"[\x20\x09-\x0D]+"
MARKS = r"[#$%&*|]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class TextFilter:
    """A filter with a one-letter name; ``fails`` is SQL over text, n_words and n_distinct."""

    name: str
    fails: str


TEXT_FILTERS = (
    TextFilter("A", "n_words < 200"),
    TextFilter("B", "100 * n_distinct < 50 * n_words"),
    TextFilter("C", f"100 * (char_length(text) - char_length(translate(text, '{UPPER}', ''))) > 3 * char_length(text)"),
    TextFilter("D", rf"text rlike r'{MARKS}'"),
)
# Fails where a document with a smaller id has the same text.
COPY = "E"


@dataclass(frozen=True)
class Edge:
    """A filter applied to what the filters of ``state`` have left; ``ways`` orders do so."""

    state: int
    bit: int
    name: str
    ways: int


def lattice(names: Sequence[str]) -> list[Edge]:
    """The edges of the subset lattice, with the number of orders that use each. Filter i has bit i."""
    full = (1 << len(names)) - 1
    bits = [1 << i for i in range(len(names))]
    forward, backward = [1] + [0] * full, [0] * full + [1]
    for state in range(1, full + 1):
        forward[state] = sum(forward[state ^ b] for b in bits if state & b)
    for state in range(full - 1, -1, -1):
        backward[state] = sum(backward[state | b] for b in bits if not state & b)
    return [
        Edge(state, b, names[i], forward[state] * backward[state | b])
        for state in range(full + 1)
        for i, b in enumerate(bits)
        if not state & b
    ]


def failures(docs: DataFrame) -> DataFrame:
    """Rows ``(doc_id, part, bits, h1, h2)``: the text filters each document fails, and its text's
    hashes. ``part`` is lang, an empty string for null. A null text is an empty one."""
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANKS), ""))
    rows = rows.select(
        "doc_id", "part", "text", F.size("words").alias("n_words"), F.size(F.array_distinct("words")).alias("n_distinct")
    )
    bits = sum(F.when(F.expr(f.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(TEXT_FILTERS))
    hashes = [h.alias(n) for h, n in zip(key_of(F.col("text")), ("h1", "h2"))]
    return rows.select("doc_id", "part", bits.alias("bits"), *hashes)


def with_copies(rows: DataFrame, bit: int) -> DataFrame:
    """``rows (doc_id, bits, h1, h2)`` with the bit set where a smaller id has the same text; a row
    without an id is no copy and makes none."""
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))
    found = skew_join(rows, first, ["h1", "h2"])
    copy = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False))
    return found.withColumn("bits", F.col("bits").bitwiseOR(F.when(copy, F.lit(bit)).otherwise(F.lit(0)))).drop("first_id")


def mask_counts(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows ``(part, bits, n, n_good, n_toxic)``: documents by part and failed filters. Of several
    labels of an id any may say that it is good or toxic; a null one says nothing."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad"),
    )
    found = skew_join(rows, said, ["doc_id"], "left")
    return found.groupBy("part", "bits").agg(
        F.count("*").alias("n"),
        F.sum(F.coalesce("good", F.lit(0))).alias("n_good"),
        F.sum(F.coalesce("bad", F.lit(0))).alias("n_toxic"),
    )


def edge_counts(counts: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per part and edge of the lattice: what the filter keeps, removes and finds removed
    already, and ``shapley``, its removals added up over all orders."""
    edges = [F.struct(*[F.lit(v).alias(n) for n, v in vars(e).items()]) for e in lattice(names)]
    rows = counts.select("part", "bits", "n", "n_good", "n_toxic", F.explode(F.array(*edges)).alias("e"))
    rows = rows.select("*", "e.*").drop("e")
    bits, state, bit = F.col("bits"), F.col("state"), F.col("bit")
    alive, fails = bits.bitwiseAND(state) == 0, bits.bitwiseAND(bit) != 0

    def total(condition: Column, value: str) -> Column:
        return F.sum(F.when(condition, F.col(value)).otherwise(F.lit(0))).cast("long")

    found = rows.groupBy("part", "state", "bit", "name", "ways").agg(
        total(alive & ~fails, "n").alias("kept"),
        total(alive & fails, "n").alias("removed"),
        total(~alive & fails, "n").alias("redundant"),
        total(bits == bit, "n").alias("unique_fails"),
        total(alive & fails, "n_good").alias("good_lost"),
        total(alive & fails, "n_toxic").alias("toxic_lost"),
    )
    own = Window.partitionBy("part", "name")
    return found.withColumn("shapley", F.sum(F.col("ways").cast("long") * F.col("removed")).over(own))


def order_steps(edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """A row per part, order of the filters and step, read from the edge that the step takes."""
    steps = []
    for order in permutations(range(len(names))):
        state = 0
        for step, i in enumerate(order, 1):
            steps.append(("".join(names[j] for j in order), step, state, 1 << i))
            state |= 1 << i
    taken = edges.sparkSession.createDataFrame(steps, "filter_order string, step int, state int, bit int")
    # As many rows as orders times filters, whatever the input: 600 for five filters.
    found = edges.join(F.broadcast(taken), ["state", "bit"])
    measures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return found.select("part", "filter_order", "step", *measures)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every order and step of the five filters for each part of ``docs (doc_id, text, lang)``, with
    what good and toxic documents of ``labels (doc_id, quality, toxic)`` each step loses.

    A null text is an empty one, a null lang the part ''; a row without an id is no copy of another
    and has no labels; repeated rows count each, and rows that share id and text are no copies of
    each other; labels of unknown documents are ignored. Texts are read whole. An empty table gives
    no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "filter-audit")
    names = [*(f.name for f in TEXT_FILTERS), COPY]
    rows = scratch.settle("failures", failures(docs))
    counts = scratch.settle("counts", mask_counts(with_copies(rows, 1 << len(TEXT_FILTERS)), labels))
    scratch.drop("failures")
    return order_steps(edge_counts(counts, names), names)
