"""Queries of catalog reading, scope, assembly and fingerprints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions import labels
from driftmark.operators import assembly, fingerprints, scope
from driftmark.schemas import DB, EXTRACT_SCHEMAS
from driftmark.sources.extracts import combine_databases, read_extracts, write_extracts
from driftmark.sources.store import SnapshotStore, shared_folder
from workload.catalog import extracts
from workload.catalog_sql import catalog_sql, extract_digests_sql, statement, user
from workload.states import table

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]

OWN = "NATION_5"
LISTED = ["NATION_1", "NATION_2", "pg_catalog"]
ENTRIES = ["NATION_3", "NATION_5.t_30", "NATION_6.t_6.x"]
# Sequences are parts whose number ends in 9.
SEQUENCES = ["NATION_9", "NATION_4.t_29"]
PLAIN = "s = 'NATION_3'"
PAIR = "s || '.' || r = 'NATION_5.t_30'"
CUT = "(s = 'NATION_6' AND r = 't_6')"


def _on(operator: Callable[..., DataFrame], *args, **kwargs) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over the derived catalog of one database."""
    return lambda spark, sf: operator(extracts(spark, sf), *args, **kwargs).drop(DB)


def _union_settled(spark: SparkSession, sf: str) -> DataFrame:
    """All kinds from shared parts that are written once."""
    store = SnapshotStore(spark, shared_folder(spark))
    return fingerprints.union_current(extracts(spark, sf), settle=store.write_scratch).drop(DB)


def _sql(last: str, **scopes: str) -> str:
    return statement(catalog_sql(**scopes), last)


def _stored_extract(spark: SparkSession, sf: str) -> DataFrame:
    """All extracts of two databases written, and those of one read back: rows and an order-free
    digest of every relation."""
    root = shared_folder(spark)
    both = {"main": extracts(spark, sf), "replica": extracts(spark, sf, "previous")}
    write_extracts(combine_databases(both), root)
    x = read_extracts(spark, root, ["replica"])
    digests = [_digest(x[name], name) for name in EXTRACT_SCHEMAS]
    return reduce(DataFrame.unionByName, digests)


def _digest(rows: DataFrame, name: str) -> DataFrame:
    def text(field) -> Column:
        plain = F.array_join(field.name, ",") if field.dataType.typeName() == "array" else F.col(field.name).cast("string")
        return F.coalesce(plain, F.lit("-"))

    whole = F.md5(F.concat_ws("|", *[text(f) for f in EXTRACT_SCHEMAS[name].fields]))
    part = F.conv(F.substring(whole, 1, 8), 16, 10).cast("long")
    return rows.groupBy(DB).agg(F.count("*").alias("n_rows"), F.sum(part).alias("digest")).withColumn("relation", F.lit(name))


def _multi_db(spark: SparkSession, sf: str) -> DataFrame:
    both = combine_databases({"main": extracts(spark, sf), "replica": extracts(spark, sf, "previous")})
    return fingerprints.fp_columns(both)


def _schemata(keep: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Schemas kept, with the number of relations in each."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        x = extracts(spark, sf)
        sizes = assembly._relations(x).groupBy(F.col("nspname").alias("schema_name")).agg(
            F.count(F.lit(1)).alias("relations")
        )
        return keep(x["schemata"].drop(DB)).join(sizes, "schema_name")

    return run


def _schemata_sql(where: str) -> str:
    return _sql(
        f"SELECT s AS schema_name, count(*) AS relations FROM x_cls WHERE {where} GROUP BY s"
    )


def _types(**columns: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        x = extracts(spark, sf)
        typ = x["type"].select(F.col("oid").alias("atttypid"), "typname")
        return x["attribute"].join(typ, "atttypid").select(
            "attrelid", "attnum", *[c().alias(n) for n, c in columns.items()]
        )

    return run


def _types_sql(*columns: str) -> str:
    return _sql(
        f"SELECT attrelid, attnum, {', '.join(columns)} FROM x_attribute JOIN x_type ON x_type.oid = atttypid"
    )


_TYPE_NAME = (
    "CASE typname WHEN 'varchar' THEN 'character varying' WHEN 'int4' THEN 'integer' WHEN 'int8' THEN 'bigint' "
    "WHEN 'timestamptz' THEN 'timestamp with time zone' ELSE typname END AS data_type"
)


_SCOPE_SQL = "SELECT 'NATION_' || (c_custkey % 25) || '.t_' || c_custkey AS entry FROM customer UNION SELECT 'NATION_' || (s_suppkey % 3) FROM supplier"


def _scoped_by_relation(operator: Callable[..., DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over a scope with an entry for each customer, which is never collected."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        entries = table(spark, sf, "customer").selectExpr("concat('NATION_', c_custkey % 25, '.t_', c_custkey) as entry")
        schemas = table(spark, sf, "supplier").selectExpr("concat('NATION_', s_suppkey % 3) as entry").distinct()
        return operator(extracts(spark, sf), entries.unionByName(schemas)).drop(DB)

    return run


def queries() -> dict[str, Query]:
    all_fetch = {
        "fetch_columns": assembly.fetch_columns,
        "fetch_constraints": assembly.fetch_constraints,
        "fetch_functions": assembly.fetch_functions,
        "fetch_indexes": assembly.fetch_indexes,
        "fetch_matviews": assembly.fetch_matviews,
        "fetch_views": assembly.fetch_views,
        "fetch_references": assembly.fetch_references,
        "fetch_sequences": assembly.fetch_sequences,
        "fetch_triggers": assembly.fetch_triggers,
    }
    out: dict[str, Query] = {
        name: (_on(op), _sql(f"SELECT * FROM x_f_{name.removeprefix('fetch_')}")) for name, op in all_fetch.items()
    }
    for op in (*fingerprints.CHILD_KINDS, fingerprints.fp_sequences, *fingerprints.ENTITY_KINDS):
        out[op.__name__] = (_on(op), _sql(f"SELECT * FROM x_{op.__name__}"))

    lists = {
        "agg_constraint_names": (
            _on(assembly.agg_constraint_names),
            "SELECT rel AS attrelid, num AS attnum, names AS constraint_name FROM x_connames",
        ),
        "agg_function_deps": (_on(assembly.agg_function_deps), "SELECT objid AS oid, dependencies FROM x_fdeps"),
        "agg_base_tables": (_on(assembly.agg_base_tables, "v"), "SELECT oid, names AS base_tables FROM x_base_v"),
        "agg_base_tables_matview": (
            _on(assembly.agg_base_tables, "m"),
            "SELECT oid, names AS base_tables FROM x_base_m",
        ),
        "agg_related_views": (_on(assembly.agg_related_views), "SELECT oid, names AS dependent_views FROM x_related"),
        "agg_view_indexes": (_on(assembly.agg_view_indexes), "SELECT oid, names AS indexes FROM x_view_ix"),
        "agg_instead_triggers": (_on(assembly.agg_instead_triggers), "SELECT oid, names AS triggers FROM x_instead"),
        "pick_sequence_owner": (
            _on(assembly.pick_sequence_owner),
            "SELECT objid AS seqrelid, table_schema, table_name, column_name, deptype FROM x_owners",
        ),
        "union_child": (_on(fingerprints.union_child), "SELECT * FROM x_child"),
        "union_entity": (_on(fingerprints.union_entity), "SELECT * FROM x_entity"),
        "union_current": (_on(fingerprints.union_current), "SELECT * FROM x_everything"),
        "union_current_settled": (_union_settled, "SELECT * FROM x_everything"),
    }
    out.update({name: (fn, _sql(sql)) for name, (fn, sql) in lists.items()})

    out["src_catalog_extract"] = (
        _stored_extract,
        statement(catalog_sql("y_", "previous"), extract_digests_sql("y_", EXTRACT_SCHEMAS)),
    )
    out["src_multi_db"] = (
        _multi_db,
        statement(
            {**catalog_sql("x_"), **catalog_sql("y_", "previous")},
            "SELECT 'main' AS source_db, * FROM x_fp_columns UNION ALL "
            "SELECT 'replica' AS source_db, * FROM y_fp_columns",
        ),
    )

    own_out = f"s NOT LIKE 'pg_%' AND s <> 'information_schema' AND s <> '{OWN}'"
    out["scope_include"] = (
        _schemata(lambda d: scope.scope_include(d, LISTED)),
        _schemata_sql("s IN ('NATION_1', 'NATION_2', 'pg_catalog')"),
    )
    out["scope_exclude"] = (
        _schemata(lambda d: scope.scope_exclude(d, LISTED, OWN)),
        _schemata_sql(own_out + " AND s NOT IN ('NATION_1', 'NATION_2')"),
    )
    out["scope_effective"] = (_schemata(lambda d: scope.scope_effective(d, OWN)), _schemata_sql(own_out))
    out["scope_system_default"] = (
        _schemata(lambda d: d.where(scope.scope_system_default("schema_name", None))),
        _schemata_sql(user("s")),
    )
    three_way = {
        "constraint": (assembly.fetch_constraints, f"(k = 'r' AND {PLAIN}) OR {PAIR} OR {CUT}"),
        "index": (assembly.fetch_indexes, f"(k IN ('r', 'm') AND {PLAIN}) OR {PAIR}"),
        "reference": (assembly.fetch_references, PAIR),
        "trigger": (assembly.fetch_triggers, f"{PLAIN} OR {PAIR}"),
    }
    for variant, (op, where) in three_way.items():
        kind = "indexes" if variant == "index" else f"{variant}s"
        out[f"scope_three_way_{variant}"] = (
            _on(op, ENTRIES),
            _sql(f"SELECT * FROM x_f_{kind}", **{kind: where}),
        )
    # No list, an empty one and one without dotted entries, where the variants differ.
    table, stored = f"k = 'r' AND {user('s')}", f"k IN ('r', 'm') AND {user('s')}"
    lists = (
        ("sequence", "sequences", assembly.fetch_sequences, SEQUENCES, "s = 'NATION_9' OR s || '.' || r = 'NATION_4.t_29'"),
        ("constraint_all", "constraints", assembly.fetch_constraints, None, table),
        ("index_all", "indexes", assembly.fetch_indexes, None, stored),
        ("index_empty", "indexes", assembly.fetch_indexes, [], stored),
        ("reference_all", "references", assembly.fetch_references, None, table),
        ("reference_empty", "references", assembly.fetch_references, [], table),
        ("reference_plain", "references", assembly.fetch_references, ["NATION_5"], "k = 'r' AND s = 'NATION_5'"),
        ("sequence_all", "sequences", assembly.fetch_sequences, None, user("s")),
        ("trigger_all", "triggers", assembly.fetch_triggers, None, "TRUE"),
    )
    for name, kind, op, entries, where in lists:
        out[f"scope_three_way_{name}"] = (_on(op, entries), _sql(f"SELECT * FROM x_f_{kind}", **{kind: where}))
    # The same from a relation: one entry for each customer's relation of a name, and a few schemas.
    related = "(s || '.' || r) IN (SELECT entry FROM x_scope)"
    named = "s IN (SELECT entry FROM x_scope)"
    for variant, op, where in (
        ("constraint", assembly.fetch_constraints, f"(k = 'r' AND {named}) OR {related}"),
        ("index", assembly.fetch_indexes, f"(k IN ('r', 'm') AND {named}) OR {related}"),
        ("reference", assembly.fetch_references, related),
        ("trigger", assembly.fetch_triggers, f"{named} OR {related}"),
    ):
        kind = "indexes" if variant == "index" else f"{variant}s"
        out[f"scope_relation_{variant}"] = (
            _scoped_by_relation(op),
            statement({"x_scope": _SCOPE_SQL, **catalog_sql(**{kind: where})}, f"SELECT * FROM x_f_{kind}"),
        )
    out["scope_relation_columns"] = (
        _scoped_by_relation(assembly.fetch_columns),
        statement({"x_scope": _SCOPE_SQL, **catalog_sql()}, f"SELECT * FROM x_f_columns WHERE schema_name IN (SELECT entry FROM x_scope)"),
    )

    out["norm_type_name"] = (_types(data_type=lambda: labels.type_name("typname")), _types_sql(_TYPE_NAME))
    out["norm_type_length"] = (
        _types(max_length=lambda: labels.type_length("typname", "atttypmod")),
        _types_sql("CASE WHEN typname = 'varchar' THEN atttypmod - 4 END AS max_length"),
    )
    out["norm_precision_scale"] = (
        _types(
            numeric_precision=lambda: labels.numeric_precision("typname", "atttypmod"),
            numeric_scale=lambda: labels.numeric_scale("typname", "atttypmod"),
        ),
        _types_sql(
            "CASE typname WHEN 'numeric' THEN ((atttypmod - 4) >> 16) & 65535 WHEN 'int4' THEN 32 "
            "WHEN 'int8' THEN 64 END AS numeric_precision",
            "CASE WHEN typname = 'numeric' THEN (atttypmod - 4) & 65535 "
            "WHEN typname IN ('int4', 'int8') THEN 0 END AS numeric_scale",
        ),
    )
    return out
