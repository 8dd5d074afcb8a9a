"""Declared schemas of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "smallint": T.ShortType(),
    "boolean": T.BooleanType(),
    "double": T.DoubleType(),
    "timestamp_ntz": T.TimestampNTZType(),
    "array<smallint>": T.ArrayType(T.ShortType()),
    "array<string>": T.ArrayType(T.StringType()),
}


def _struct(columns: str) -> T.StructType:
    """``name type, ...`` as a schema; unlike fromDDL it needs no session."""
    pairs = (c.split() for c in columns.split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


DB = "source_db"
"""Optional first column everywhere: one job can cover many databases."""

CHILD_KEYS = (
    "schema_name",
    "object_type",
    "object_type_name",
    "object_subtype",
    "object_subtype_name",
)
"""Identity of a child row: a column, constraint, index, reference, trigger or owned sequence."""

ENTITY_KEYS = ("schema_name", "object_type", "object_type_name")
"""Identity of an entity row: a function, view, materialized view or free sequence."""

FINGERPRINT_COLUMNS = (*CHILD_KEYS, "object_subtype_details", "object_md5")

FINGERPRINT_SCHEMA = _struct(", ".join(f"{c} string" for c in FINGERPRINT_COLUMNS))

REGISTRY_SCHEMA = _struct("snapshot_id int, snapshot_name string, processed_time timestamp_ntz")

_ROW = (
    "snapshot_id int, schema_name string, object_type string, object_type_name string, "
    "object_subtype string, object_subtype_name string, object_subtype_details string, "
    "object_md5 string, processed_time timestamp_ntz"
)

STATE_SCHEMA = _struct(_ROW)

# ``copies`` is how many identical log rows one stored row stands for; see operators.diff.
CHANGES_SCHEMA = _struct(_ROW + ", change_type string, copies bigint")

METRICS_SCHEMA = _struct(
    "snapshot_id int, metric_name string, metric_value bigint, metrics_time timestamp_ntz"
)

RUN_REPORT_SCHEMA = _struct(
    "snapshot_id int, step_no int, step_name string, result string, seconds double"
)


# Rows and hash sums of a staged state, kept when the state itself is retired.
STATE_DIGEST_SCHEMA = _struct("snapshot_id int, level string, n_rows bigint, h1 string, h2 string")


def with_db(schema: T.StructType) -> T.StructType:
    """The same schema for a store that holds several databases."""
    return T.StructType([T.StructField(DB, T.StringType()), *schema.fields])


# Catalog extracts: one Parquet set per source relation, partitioned by source_db. Text that
# only the database server can render (definitions, expressions, type names) is a column.
EXTRACT_SCHEMAS = {
    "schemata": _struct("schema_name string"),
    "namespace": _struct("oid bigint, nspname string"),
    "class": _struct(
        "oid bigint, relnamespace bigint, relname string, relkind string, relam bigint, "
        "reltablespace bigint, relacl string, relowner string, relispopulated boolean, "
        "viewdef string"
    ),
    "attribute": _struct(
        "attrelid bigint, attnum smallint, attname string, atttypid bigint, atttypmod int, "
        "attnotnull boolean, attisdropped boolean"
    ),
    "type": _struct("oid bigint, typname string"),
    "attrdef": _struct("adrelid bigint, adnum smallint, default_expr string"),
    "constraint": _struct(
        "oid bigint, conname string, conrelid bigint, contype string, conkey array<smallint>, "
        "confrelid bigint, confkey array<smallint>, definition string"
    ),
    "proc": _struct(
        "oid bigint, pronamespace bigint, proname string, prolang bigint, provolatile string, "
        "proparallel string, owner string, proacl string, prosecdef boolean, "
        "config array<string>, args string, identity_args string, return_type string, "
        "prosrc string, functiondef string"
    ),
    "language": _struct("oid bigint, lanname string"),
    "depend": _struct(
        "classid bigint, objid bigint, refclassid bigint, refobjid bigint, refobjsubid int, "
        "ref_name string, deptype string"
    ),
    "rewrite": _struct("oid bigint, ev_class bigint"),
    "index": _struct(
        "indexrelid bigint, indrelid bigint, indkey array<smallint>, indisunique boolean, "
        "indisprimary boolean, indexdef string, predicate string"
    ),
    "am": _struct("oid bigint, amname string"),
    "tablespace": _struct("oid bigint, spcname string"),
    "sequence": _struct(
        "seqrelid bigint, seqstart bigint, seqmin bigint, seqmax bigint, seqincrement bigint, "
        "seqcache bigint, seqcycle boolean, type_name string"
    ),
    "trigger": _struct(
        "oid bigint, tgrelid bigint, tgname string, tgtype smallint, tgenabled string, "
        "tgisinternal boolean, triggerdef string, function_name string, function_args string, "
        "functiondef string"
    ),
}
