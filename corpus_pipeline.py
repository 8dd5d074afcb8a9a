"""A corpus from language ID to token ids: five stages, each written and read by the next.

Every stage works on all that its predecessor kept and takes effect: texts without a language go,
repeated lines go, one document of each near-duplicate group stays, benchmark passages are cut out,
and what is left is encoded. All but the last stage return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import decontaminate, jaccard, language, lattice, line_dedup, pieces
from driftmark.llm.common import Scratch, key_of
from driftmark.llm.queries import PIECE_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _same(left: str, right: str):
    return F.col(left).eqNullSafe(F.col(right))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a language was found for without doubt. Learns from all labelled ones."""
    model = language.train(docs)
    found = language.predict(docs, model, keep=COLUMNS)
    return found.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; one that has lost all its words goes."""
    found = line_dedup.dedup_lines(docs, keep=COLUMNS)
    changed = F.col("n_dropped") > 0
    text = F.when(changed, F.col("kept")).otherwise(F.col("text"))
    found = found.select("doc_id", text.alias("text"), "lang", "source", _size(changed, text).alias("n_chars"), changed.alias("changed"))
    return found.where(~F.col("changed") | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*COLUMNS)


def _size(changed, text):
    return F.when(changed, F.char_length(text).cast("long")).otherwise(F.col("n_chars"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents with a hash of their text: rows that share an id are told apart."""
    return docs.withColumns(dict(zip(("h1", "h2"), key_of(F.coalesce("text", F.lit(""))))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates, which share at least 0.8
    of their 5-word shingles; one without an id only where no other is there. Of equal rows one
    stays."""
    rows = _keyed(docs)
    key = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h1", "h2")
    groups = jaccard.near_duplicates(rows.select(key.alias("doc_id"), "text"))
    first = groups.where("doc_id = component_id").select("doc_id.*").distinct()
    first = first.select(F.col("doc_id").alias("first_id"), F.col("h1").alias("f1"), F.col("h2").alias("f2"))
    first = Scratch(spark, "pipeline").settle("first", first)
    met = _same("doc_id", "first_id") & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))
    kept = rows.join(first.hint("merge"), met, "left_semi")
    return kept.dropDuplicates(["doc_id", "h1", "h2"]).select(*COLUMNS)


def cut_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark passages; one that has no other words goes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = _keyed(docs).withColumn("key", F.to_json(F.struct("doc_id", "h1", "h2")))
    found = decontaminate.contamination(rows.select(F.col("key").alias("doc_id"), "text"), items)
    found = found.where(F.size("spans") > 0).dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("key"), "spans")
    found = Scratch(spark, "pipeline").settle("hits", found)
    rows = rows.join(found.hint("merge"), "key", "left")
    hit = F.col("spans").isNotNull()
    text = F.when(hit, decontaminate.without_spans(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    rows = rows.select("doc_id", text.alias("text"), "lang", "source", "n_chars", hit.alias("hit"))
    rows = rows.where(~F.col("hit") | F.col("text").rlike(r"[0-9A-Za-z]|[^\x00-\x7F]"))
    return rows.select("doc_id", "text", "lang", "source", _size(F.col("hit"), F.col("text")).alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether decoding gives its text back."""
    model = pieces.load(PIECE_MODEL)
    found = lattice.round_trip(lattice.encode(docs, model), model)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


STAGES = [
    ("language", identify_language),
    ("lines", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("benchmarks", cut_benchmarks),
    ("tokens", encode),
]

# XXH64, the learnt language model and the lattice have no words in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written as Parquet and read again."""
    scratch = Scratch(spark, "stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.settle(f"stage-{i}", stage(spark, docs, sf_dir))
        if i:
            scratch.drop(f"stage-{i - 1}")
    return docs
