"""Fingerprints: canonical details text and its MD5, one row per object.

Which parts are hashed, in which order and with which separator decides what counts as a change,
so each kind spells its parts out. All of it is built-in expressions, without a UDF.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions.canon import collapse_ws, joined, kv, kv_if_set, sorted_list, text
from driftmark.operators import assembly
from driftmark.operators.joins import released_shuffles
from driftmark.operators.scope import Entries, scope_three_way, scoped
from driftmark.schemas import CHILD_KEYS, DB
from driftmark.sources.extracts import Extracts


def fp_rows(
    df: DataFrame,
    keys: Mapping[str, Column | str | None],
    details: Column,
    hashed: Column | None = None,
) -> DataFrame:
    """Fingerprint rows: the five identity columns, ``details`` and the MD5 of ``hashed``
    (of ``details`` when not given). A missing or None key is NULL."""
    identity = []
    for name in CHILD_KEYS:
        value = keys.get(name)
        value = F.lit(value) if isinstance(value, str) or value is None else value
        identity.append(value.cast("string").alias(name))
    return df.select(
        *[c for c in (DB,) if c in df.columns],
        *identity,
        details.alias("object_subtype_details"),
        F.md5(details if hashed is None else hashed).alias("object_md5"),
    )


def fp_table(
    df: DataFrame,
    keys: Mapping[str, Column | str | None],
    payload: Mapping[str, Column],
    *,
    sep: str = ",",
    name_in_hash: bool = False,
) -> DataFrame:
    """The same canonical form for any keyed table.

    ``name_in_hash`` puts the identity into the hash too, so that a renamed row shows as an
    added and a deleted one. Floating-point payload is refused: its text differs between engines
    and versions, so cast it to a decimal first.
    """
    for f in df.select(*[c.alias(n) for n, c in payload.items()]).schema.fields:
        if f.dataType.typeName() in ("float", "double"):
            raise ValueError(f"cast {f.name} to a decimal before fingerprinting it")
    details = joined([kv(n, c) for n, c in payload.items()], sep)
    if not name_in_hash:
        return fp_rows(df, keys, details)
    named = [F.lit(v) if isinstance(v, str) else v for v in (keys.get(k) for k in CHILD_KEYS) if v is not None]
    return fp_rows(df, keys, details, joined([*named, details], sep))


def _key(kind_column: str | Column, name: str, subtype: str | None = None, subname: str | None = None):
    return {
        "schema_name": F.col("schema_name"),
        "object_type": kind_column,
        "object_type_name": F.col(name),
        "object_subtype": subtype,
        "object_subtype_name": None if subname is None else F.col(subname),
    }


def _kvs(labels: Mapping[str, str]) -> list[Column]:
    return [kv(label, source) for label, source in labels.items()]


def fp_columns(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Columns. The name is not hashed, the position is: a rename in place keeps the MD5."""
    parts = _kvs(
        {
            "data_type": "data_type",
            "max_length": "character_maximum_length",
            "numeric_precision": "numeric_precision",
            "numeric_scale": "numeric_scale",
            "nullable": "is_nullable",
            "default_value": "column_default",
            "is_identity": "is_identity",
            "is_generated": "is_generated",
            "generation_expression": "generation_expression",
            "constraint_name": "constraint_name",
            "ordinal_position": "ordinal_position",
        }
    )
    keys = _key(F.col("object_type"), "object_type_name", "Column", "column_name")
    return fp_rows(assembly.fetch_columns(x, schemas), keys, joined(parts, ","))


def fp_constraints(x: Extracts, entries: Entries = None) -> DataFrame:
    """Constraints. Schema, table and name are hashed."""
    details = collapse_ws(
        joined(
            [
                kv("constraint_type", "constraint_type"),
                kv("column_name", "column_name"),
                kv("definition", collapse_ws("definition")),
            ],
            ",",
        )
    )
    hashed = joined(
        [
            kv_if_set("schema", "schema_name"),
            kv_if_set("table", "object_type_name"),
            kv_if_set("constraint", "constraint_name"),
            details,
        ],
        ":",
    )
    keys = _key(F.col("object_type"), "object_type_name", "Constraint", "constraint_name")
    return fp_rows(assembly.fetch_constraints(x, entries), keys, details, hashed)


def fp_functions(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Routines. Name, security mode and settings are not hashed; owner and privileges are."""
    names = (
        "argument_types",
        "argument_modes",
        "return_type",
        "language",
        "volatility",
        "parallel_safe",
        "owner_role",
        "privileges",
        "dependencies",
        "function_body",
    )
    parts = _kvs({n: n for n in names})
    return fp_rows(
        assembly.fetch_functions(x, schemas), _key("Function", "function_name"), joined(parts, ",")
    )


def fp_indexes(x: Extracts, entries: Entries = None) -> DataFrame:
    """Indexes. The name is hashed as part of the definition."""
    names = (
        "tablespace",
        "indexdef",
        "is_unique",
        "is_primary",
        "index_columns",
        "index_predicate",
        "access_method",
    )
    parts = _kvs({n: n for n in names})
    keys = _key(F.col("object_type"), "object_type_name", "Index", "index_name")
    return fp_rows(assembly.fetch_indexes(x, entries), keys, joined(parts, ","), joined(parts, ":"))


def fp_matviews(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Materialized views. A NULL part is dropped whole; the hash joins bare values."""
    names = ("view_type", "view_definition", "base_tables", "is_populated", "view_owner", "dependent_objects")
    never_null = {"base_tables", "dependent_objects"}
    details = [kv(n, n) if n in never_null else kv_if_set(n, n) for n in names]
    bare = [text(n) if n in never_null else F.col(n).cast("string") for n in names]
    return fp_rows(
        assembly.fetch_matviews(x, schemas),
        _key("Materialized View", "view_name"),
        joined(details, ","),
        joined(bare, ":"),
    )


def fp_views(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Views. The definition keeps its whitespace."""
    names = ("view_type", "view_definition", "base_tables", "view_owner", "dependent_objects")
    parts = _kvs({n: n for n in names})
    return fp_rows(
        assembly.fetch_views(x, schemas), _key("View", "view_name"), joined(parts, ","), joined(parts, ":")
    )


def fp_references(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Foreign keys. Source and target columns are sorted each on their own, so a changed pairing
    goes unseen; the target schema is shown but not hashed."""
    relations = assembly._relations(x)
    sources = (relations if schemas is None else scoped(relations, "system_default", schemas)).select(
        DB, F.col("oid").alias("conrelid"), "nspname", "relname"
    )
    fk = (
        assembly.fk_pairs(x, sources)
        .groupBy(DB, "constraint_name", "schema_name", "table_name", "target_table", "target_schema")
        .agg(
            sorted_list("source_column", ",").alias("source_columns"),
            sorted_list("target_column", ",").alias("target_columns"),
        )
    )
    details = F.concat(
        F.lit("source_columns:{"), text("source_columns"),
        F.lit("},target_schema:"), text("target_schema"),
        F.lit(",target_table:"), text("target_table"),
        F.lit(",target_columns:{"), text("target_columns"),
        F.lit("},constraint_name:"), text("constraint_name"),
    )
    hashed = joined(
        [
            kv("src", "source_columns"),
            kv("tgt", "target_columns"),
            kv("tbl", "table_name"),
            kv("ref", "target_table"),
            kv("cons", "constraint_name"),
        ],
        " ",
    )
    return fp_rows(fk, _key("Table", "table_name", "Reference", "constraint_name"), details, hashed)


def fp_sequences(x: Extracts, entries: Entries = None) -> DataFrame:
    """Sequences. An owned one is a child of its table, a free one an entity of its own."""
    coalesced = ("owned_by", "sequence_type", "privileges", "data_type")
    settings = (
        "start_value",
        "minimum_value",
        "maximum_value",
        "increment_by",
        "cycle_option",
        "cache_size",
    )
    owned = F.col("table_name").isNotNull()
    keys = {
        "schema_name": F.col("schema_name"),
        "object_type": F.when(owned, F.lit("Table")).otherwise(F.lit("Sequence")),
        "object_type_name": F.coalesce("table_name", "object_type_name"),
        "object_subtype": F.when(owned, F.lit("Sequence")),
        "object_subtype_name": F.when(owned, F.col("object_type_name")),
    }
    return fp_rows(
        assembly.fetch_sequences(x, entries),
        keys,
        joined([*_kvs({n: n for n in coalesced}), *[kv_if_set(n, n) for n in settings]], ","),
        joined([*[text(n) for n in coalesced], *[F.col(n).cast("string") for n in settings]], ":"),
    )


def fp_triggers(x: Extracts, entries: Entries = None, *, corrected: bool = False) -> DataFrame:
    """Triggers. All identity columns are hashed."""
    before = ("trigger_definition", "trigger_event", "trigger_timing", "trigger_level")
    after = ("trigger_function_name", "trigger_function_arguments", "trigger_function_definition")
    details = collapse_ws(
        joined(
            [
                *_kvs({n: n for n in before}),
                kv_if_set("trigger_enabled", "trigger_enabled"),
                *_kvs({n: n for n in after}),
            ],
            ",",
        )
    )
    hashed = joined(
        ["schema_name", "object_type", "object_type_name", F.lit("Trigger"), "trigger_name", details], "||"
    )
    keys = _key(F.col("object_type"), "object_type_name", "Trigger", "trigger_name")
    return fp_rows(assembly.fetch_triggers(x, entries, corrected=corrected), keys, details, hashed)


Fingerprint = Callable[[Extracts, Entries], DataFrame]

CHILD_KINDS: Sequence[Fingerprint] = (
    fp_columns,
    fp_constraints,
    fp_indexes,
    fp_references,
    fp_triggers,
)
ENTITY_KINDS: Sequence[Fingerprint] = (fp_functions, fp_views, fp_matviews)


Settle = Callable[[str, DataFrame], DataFrame]


def _distinct_union(parts: Sequence[DataFrame]) -> DataFrame:
    """Distinct rows of all kinds; rows of different kinds never coincide. Equal rows have equal identities, and
    mostly none repeats, which a job over the identities alone tells: whole rows are then not shuffled."""
    rows = reduce(DataFrame.unionByName, parts)
    identities = rows.select(*[c for c in (DB, *CHILD_KEYS) if c in rows.columns])
    with released_shuffles(rows.sparkSession):
        none = repeated(identities).isEmpty()
    return rows if none else rows.distinct()


def repeated(rows: DataFrame) -> DataFrame:
    """Two hashes of each row that occurs more than once; only hashes are shuffled to find them. Null
    columns count as equal. Rows that differ may share both hashes, but equal ones always do."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in rows.columns]
    hashes = [F.xxhash64(F.lit(seed), *filled).alias(f"_{seed}") for seed in ("one", "two")]
    return rows.select(*hashes).groupBy("_one", "_two").agg(F.count("*").alias("n")).where("n > 1").drop("n")


def _union(
    name: str, x: Extracts, kinds: Callable[[Extracts], Sequence[DataFrame]], settle: Settle | None, distinct: bool
) -> DataFrame:
    """Distinct rows of all kinds, or all of them, for who makes them distinct where they are written.
    With ``settle``, what several kinds read is computed once, and the
    rows are written once: only identities and hashes are shuffled to find those that occur more than
    once, and only these are made distinct, so bodies and definitions stay where they are."""
    if not distinct:
        return reduce(DataFrame.unionByName, kinds(x))
    if settle is None:
        return _distinct_union(kinds(x))
    shared = assembly.settled(x, lambda part, df: settle(f"{name}-{part}", df))
    rows = settle(f"{name}-rows", reduce(DataFrame.unionByName, kinds(shared)))
    # Null columns count as equal here; two hashes of the whole row stand for it.
    whole = [F.xxhash64(F.lit(seed), F.to_json(F.struct(*rows.columns))).alias(f"_{seed}") for seed in ("one", "two")]
    keyed = rows.select("*", *whole)
    repeated = keyed.groupBy("_one", "_two").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = settle(f"{name}-repeated", repeated)
    once = keyed.join(repeated, ["_one", "_two"], "left_anti").select(*rows.columns)
    several = keyed.join(repeated, ["_one", "_two"], "left_semi").select(*rows.columns)
    return once.unionByName(several.distinct())


def union_child(
    x: Extracts, schemas: Entries = None, *, settle: Settle | None = None, distinct: bool = True
) -> DataFrame:
    """Current child rows of the five child kinds and of owned sequences."""

    def kinds(x: Extracts) -> list[DataFrame]:
        owned = fp_sequences(x, schemas).where(F.col("object_type") == "Table")
        return [*[fp(x, schemas) for fp in CHILD_KINDS], owned]

    return _union("child", x, kinds, settle, distinct)


def union_entity(
    x: Extracts, schemas: Entries = None, *, settle: Settle | None = None, distinct: bool = True
) -> DataFrame:
    """Current entity rows of the three entity kinds and of free sequences."""

    def kinds(x: Extracts) -> list[DataFrame]:
        free = fp_sequences(x, schemas).where(F.col("object_type") == "Sequence")
        return [*[fp(x, schemas) for fp in ENTITY_KINDS], free]

    return _union("entity", x, kinds, settle, distinct)


def union_current(
    x: Extracts, schemas: Entries = None, *, settle: Settle | None = None, distinct: bool = True
) -> DataFrame:
    """Current rows of all nine kinds."""
    kinds = [*CHILD_KINDS, fp_sequences, *ENTITY_KINDS]
    return _union("current", x, lambda x: [fp(x, schemas) for fp in kinds], settle, distinct)
