"""The operators as queries over the test tables, each with its DuckDB SQL where SQL has the words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.llm import (
    decontaminate,
    filter_audit,
    html_extract,
    language,
    lattice,
    line_dedup,
    pieces,
    quality,
    simhash,
    suffix_dedup,
    tile_search,
    token_counts,
    url_filter,
    vector_codes,
)
from driftmark.llm.sql import (
    DECONTAMINATE_SQL,
    FILTER_AUDIT_SQL,
    LINE_DEDUP_SQL,
    QUALITY_SQL,
    SUFFIX_SQL,
    TILE_SEARCH_SQL,
    URL_SQL,
    VECTOR_CODES_SQL,
)

URL_RULES: tuple[url_filter.Rule, ...] = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)

# A public model file, read on the driver.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(_table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load(PIECE_MODEL)
    found = lattice.round_trip(lattice.encode(_table(spark, sf_dir, "documents"), model), model)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "lossless")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), pieces.load(PIECE_MODEL))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(quality.ledger(_table(spark, sf_dir, "documents")))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("doc_id", *base, "base_failed", "kept", "failure_bits")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(_table(spark, sf_dir, "embeddings"))
    digest = F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256")
    return vector_codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", digest)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_tile_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tile_search.self_search(_table(spark, sf_dir, "embeddings"))


def registered() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    """Query name to (function of session and data folder, SQL or None)."""
    return {
        "op1_language": (op1_language, None),
        "op2_html_extract": (op2_html_extract, None),
        "op3_url_filter": (op3_url_filter, URL_SQL),
        "op4_sentencepiece": (op4_sentencepiece, None),
        "op5_decontaminate": (op5_decontaminate, DECONTAMINATE_SQL),
        "op6_line_dedup": (op6_line_dedup, LINE_DEDUP_SQL),
        "op7_token_counts": (op7_token_counts, None),
        "op8_suffix_dedup": (op8_suffix_dedup, SUFFIX_SQL),
        "op9_quality_rules": (op9_quality_rules, QUALITY_SQL),
        "op10_simhash": (op10_simhash, None),
        "op11_vector_codes": (op11_vector_codes, VECTOR_CODES_SQL),
        "op12_filter_audit": (op12_filter_audit, FILTER_AUDIT_SQL),
        "op13_tile_search": (op13_tile_search, TILE_SEARCH_SQL),
    }
