"""Which schemas and relations a run looks at.

A scope is a list of names or a relation of them, a DataFrame with the column ``entry``. A list becomes
a predicate, which reaches the scan; a relation is joined, so that it can be of any size: its entries
are never collected and never part of a plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions.canon import ColumnOrName, col

SYSTEM_SCHEMAS = ("pg_catalog", "information_schema")

Entries = Sequence[str] | DataFrame | None


def scope_include(schemata: DataFrame, schemas: Entries) -> DataFrame:
    """The listed schemas; no list keeps nothing."""
    if isinstance(schemas, DataFrame):
        return _listed(schemata, schemas, "schema_name", "left_semi")
    return schemata.where(col("schema_name").isin(list(schemas or ())))


def scope_exclude(schemata: DataFrame, schemas: Entries, own: str) -> DataFrame:
    """All user schemas but the engine's ``own`` and the listed ones; no list keeps nothing.

    ``_`` in the pattern is a wildcard, so a schema called ``pgdata`` counts as a system one.
    """
    if schemas is None:
        return schemata.where(F.lit(False))
    name = F.col("schema_name")
    user = schemata.where(~name.like("pg_%") & (name != "information_schema") & (name != own))
    if isinstance(schemas, DataFrame):
        return _listed(user, schemas, "schema_name", "left_anti")
    return user.where(~name.isin(list(schemas)))


def scope_effective(schemata: DataFrame, own: str) -> DataFrame:
    """Every user schema but the engine's own."""
    return scope_exclude(schemata, (), own)


def is_user_schema(schema: ColumnOrName) -> Column:
    return ~col(schema).isin(*SYSTEM_SCHEMAS)


def scope_system_default(schema: ColumnOrName, schemas: Entries) -> Column:
    """The listed schemas, or all but the system ones when there is no list."""
    return is_user_schema(schema) if schemas is None else col(schema).isin(list(schemas))


def scope_user_only(schema: ColumnOrName, schemas: Entries) -> Column:
    """Like :func:`scope_system_default`, but a listed system schema stays out."""
    keep = is_user_schema(schema)
    return keep if schemas is None else keep & col(schema).isin(list(schemas))


def _listed(rows: DataFrame, entries: DataFrame, column: str, how: str) -> DataFrame:
    """Rows whose column is an entry (``left_semi``) or is none (``left_anti``)."""
    names = entries.select(F.col("entry").alias("_entry")).where("_entry IS NOT NULL")
    return rows.join(names, rows[column] == names["_entry"], how)


def scoped(rows: DataFrame, variant: str, entries: Entries) -> DataFrame:
    """Rows with ``nspname``, ``relname`` and ``relkind`` that a scope keeps, by the rules of
    ``system_default``, ``user_only`` or a variant of :func:`scope_three_way`.

    A list is applied as a predicate. A relation is looked up twice, as schemas and as relations, and
    the variant's rule is then read off what was found; null entries match nothing.
    """
    simple = {"system_default": scope_system_default, "user_only": scope_user_only}
    if not isinstance(entries, DataFrame):
        if variant in simple:
            return rows.where(simple[variant]("nspname", entries))
        kind = "relkind" if variant in ("constraint", "index", "reference") else None
        return rows.where(scope_three_way(variant, entries, "nspname", "relname", kind))

    names = entries.select("entry").where("entry IS NOT NULL").distinct()
    if variant in simple:
        kept = rows.where(is_user_schema("nspname")) if variant == "user_only" else rows
        return _listed(kept, names, "nspname", "left_semi")
    dotted = F.col("entry").contains(".")
    if variant in ("index", "reference") and names.isEmpty():
        return scoped(rows, variant, [])
    if variant == "constraint":
        # An entry with a dot is cut at its first two dots.
        parts = F.split("entry", r"\.")
        pairs = names.where(dotted).select(parts[0].alias("_schema"), parts[1].alias("_relation")).distinct()
        pair = (F.col("nspname") == F.col("_schema")) & (F.col("relname") == F.col("_relation"))
    else:
        pairs = names.select(F.col("entry").alias("_relation"), F.lit("").alias("_schema"))
        pair = _qualified("nspname", "relname") == F.col("_relation")
    schemas = names.select(F.col("entry").alias("_plain"))
    found = rows.join(schemas, F.col("nspname") == F.col("_plain"), "left").join(pairs, pair, "left")
    by_schema, by_pair = F.col("_plain").isNotNull(), F.col("_relation").isNotNull()
    if variant in ("constraint", "index", "reference"):
        # A plain entry names a schema; one with a dot is never one here.
        by_schema = by_schema & ~F.col("_plain").contains(".")
        by_pair = by_pair & ((variant == "constraint") | F.col("_relation").contains("."))
    if variant == "constraint":
        keep = ((F.col("relkind") == "r") & by_schema) | by_pair
    elif variant == "index":
        keep = (F.col("relkind").isin("r", "m") & by_schema) | by_pair
    elif variant == "reference":
        any_dotted = not names.where(dotted).isEmpty()
        keep = by_pair if any_dotted else (F.col("relkind") == "r") & by_schema
    elif variant in ("sequence", "trigger"):
        keep = by_schema | by_pair
    else:
        raise ValueError(f"unknown scope variant: {variant}")
    return found.where(keep).drop("_plain", "_schema", "_relation")


def _qualified(schema: ColumnOrName, name: ColumnOrName) -> Column:
    return F.concat(col(schema), F.lit("."), col(name))


def scope_three_way(
    variant: str,
    entries: Entries,
    schema: ColumnOrName,
    name: ColumnOrName,
    relkind: ColumnOrName | None = None,
) -> Column:
    """Entries are ``schema`` or ``schema.relation``; the four variants differ at the edges.

    ``constraint``: no list is every user table; an entry with a dot is cut at its first two dots.
    ``index``: no list and an empty one are both every user table and materialized view.
    ``reference``: the same for tables, and one dotted entry turns all plain entries off.
    ``sequence``: no list is every user schema. ``trigger``: no list is everything.
    """
    schema, name = col(schema), col(name)
    listed = list(entries or ())
    plain = [e for e in listed if "." not in e]
    dotted = [e for e in listed if "." in e]

    if variant == "constraint":
        table = col(relkind) == "r"
        if entries is None:
            return table & is_user_schema(schema)
        keep = table & schema.isin(plain)
        for parts in (e.split(".") for e in dotted):
            keep = keep | ((schema == parts[0]) & (name == parts[1]))
        return keep

    if variant == "index":
        stored = col(relkind).isin("r", "m")
        if not listed:
            return stored & is_user_schema(schema)
        return (stored & schema.isin(plain)) | _qualified(schema, name).isin(dotted)

    if variant == "reference":
        table = col(relkind) == "r"
        if not listed:
            return table & is_user_schema(schema)
        if dotted:
            return _qualified(schema, name).isin(dotted)
        return table & schema.isin(plain)

    if variant == "sequence":
        if entries is None:
            return is_user_schema(schema)
        return schema.isin(listed) | _qualified(schema, name).isin(listed)

    if variant == "trigger":
        if entries is None:
            return F.lit(True)
        return schema.isin(listed) | _qualified(schema, name).isin(listed)

    raise ValueError(f"unknown scope variant: {variant}")
