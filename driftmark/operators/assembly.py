"""Catalog assembly: joins extract relations into one normalised row per object.

All joins are on ``source_db`` and an object id, so they spread over objects. Lists that become
one text cell are made distinct on (owner, member) first; only the members that the cell itself
has to hold then meet in one group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.functions import labels
from driftmark.functions.canon import collapse_ws, joined, sorted_list, text, tighten_parens
from driftmark.operators.scope import Entries, scoped
from driftmark.schemas import DB
from driftmark.sources.extracts import Extracts

# Object ids of the catalog's own relations, the same on every server.
PROC_CLASS = 1255
RELATION_CLASS = 1259


def _renamed(df: DataFrame, **names: str) -> DataFrame:
    """``source_db`` and the given columns, under new names."""
    return df.selectExpr(DB, *[f"{old} as {new}" for new, old in names.items()])


# What several kinds read, settled once by `settled`; its names are those of no extract relation.
RELATIONS, COLUMN_NAMES, VIEW_READS = "settled_relations", "settled_columns", "settled_view_reads"


def settled(x: Extracts, settle: Callable[[str, DataFrame], DataFrame]) -> Extracts:
    """Extracts with what several kinds read computed once, narrow: relations with their schema's name
    and without definitions, names of columns, and which relations views read. ``settle`` writes a
    frame and reads it back."""
    # A list, so that each relation is one row here however many schema rows it meets.
    schemas = x["namespace"].groupBy(DB, F.col("oid").alias("relnamespace"))
    schemas = schemas.agg(F.collect_list(F.struct("nspname")).alias("schemas"))
    wide = [c for c in x["class"].columns if c != "viewdef"]
    out = dict(x.items())
    # One without a schema's row is still an index's or a view's own entry.
    out[RELATIONS] = settle(RELATIONS, x["class"].select(*wide).join(schemas, [DB, "relnamespace"], "left"))
    out[COLUMN_NAMES] = settle(COLUMN_NAMES, _columns(x))
    out[VIEW_READS] = settle(VIEW_READS, _every_view_read(out))
    return out


def _shared(x: Extracts, name: str) -> DataFrame:
    """A settled frame, joined by sorting. Its files are a fraction of its rows in memory, so that Spark
    would take it for small and gather it on the driver for each of the kinds that read it."""
    return x[name].hint("merge")


def _class(x: Extracts) -> DataFrame:
    """Relations without their definition."""
    return _shared(x, RELATIONS) if RELATIONS in x else x["class"]


def _relations(x: Extracts, where: Column | None = None, *, definitions: bool = False) -> DataFrame:
    """Relations with their schema name, and with their definition if asked for."""
    if RELATIONS in x and not definitions:
        out = _shared(x, RELATIONS).select("*", F.explode("schemas").alias("of")).select("*", "of.nspname").drop("schemas", "of")
    else:
        ns = _renamed(x["namespace"], relnamespace="oid", nspname="nspname")
        out = x["class"].join(ns, [DB, "relnamespace"])
    return out if where is None else out.where(where)


def _columns(x: Extracts) -> DataFrame:
    return _shared(x, COLUMN_NAMES) if COLUMN_NAMES in x else x["attribute"].select(DB, "attrelid", "attnum", "attname")


def agg_constraint_names(x: Extracts) -> DataFrame:
    """Per relation and column number: its constraints' names, distinct and sorted."""
    return (
        x["constraint"]
        .select(DB, F.col("conrelid").alias("attrelid"), F.explode("conkey").alias("attnum"), "conname")
        .distinct()
        .groupBy(DB, "attrelid", "attnum")
        .agg(sorted_list("conname", ",").alias("constraint_name"))
    )


def fetch_columns(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Columns of tables, views and materialized views."""
    rel = scoped(
        _relations(x, F.col("relkind").isin(*labels.RELATION_KINDS)), "system_default", schemas
    ).select(DB, F.col("oid").alias("attrelid"), "nspname", "relname", "relkind")
    att = x["attribute"].where((F.col("attnum") > 0) & ~F.col("attisdropped"))
    typ = _renamed(x["type"], atttypid="oid", typname="typname")
    default = _renamed(x["attrdef"], attrelid="adrelid", attnum="adnum", default_expr="default_expr")
    return (
        att.join(rel, [DB, "attrelid"])
        .join(typ, [DB, "atttypid"])
        .join(default, [DB, "attrelid", "attnum"], "left")
        .join(agg_constraint_names(x), [DB, "attrelid", "attnum"], "left")
        .select(
            DB,
            F.col("nspname").alias("schema_name"),
            labels.label("relkind", labels.RELATION_KINDS, "'Other'").alias("object_type"),
            F.col("relname").alias("object_type_name"),
            F.col("attname").alias("column_name"),
            labels.type_name("typname").alias("data_type"),
            labels.type_length("typname", "atttypmod").alias("character_maximum_length"),
            labels.numeric_precision("typname", "atttypmod").alias("numeric_precision"),
            labels.numeric_scale("typname", "atttypmod").alias("numeric_scale"),
            F.when(F.col("attnotnull"), F.lit("NO")).otherwise(F.lit("YES")).alias("is_nullable"),
            F.col("default_expr").alias("column_default"),
            F.lit("NO").alias("is_identity"),
            F.lit("NEVER").alias("is_generated"),
            F.lit(None).cast("string").alias("generation_expression"),
            "constraint_name",
            F.col("attnum").cast("int").alias("ordinal_position"),
        )
    )


def fetch_constraints(x: Extracts, entries: Entries = None) -> DataFrame:
    """Constraints with their columns in table order and their definition."""
    rel = scoped(_relations(x), "constraint", entries).select(DB, F.col("oid").alias("conrelid"), "nspname", "relname")
    con = x["constraint"].join(rel, [DB, "conrelid"])
    members = (
        con.where(F.col("contype").isin("p", "u", "f"))
        .select(DB, "oid", F.col("conrelid").alias("attrelid"), F.explode("conkey").alias("attnum"))
        .join(_columns(x), [DB, "attrelid", "attnum"])
        .groupBy(DB, "oid")
        .agg(sorted_list("attname", ",", by="attnum").alias("column_name"))
    )
    return con.join(members, [DB, "oid"], "left").select(
        DB,
        F.col("nspname").alias("schema_name"),
        F.lit("Table").alias("object_type"),
        F.col("relname").alias("object_type_name"),
        F.col("conname").alias("constraint_name"),
        labels.label("contype", labels.CONSTRAINT_KINDS, "contype").alias("constraint_type"),
        "column_name",
        "definition",
    )


def agg_function_deps(x: Extracts) -> DataFrame:
    """Per routine: the names it depends on, in catalog order."""
    return (
        x["depend"]
        .where(F.col("classid") == PROC_CLASS)
        .groupBy(DB, F.col("objid").alias("oid"))
        .agg(
            sorted_list("ref_name", ",", by="refclassid, refobjid, refobjsubid").alias("dependencies")
        )
    )


def fetch_functions(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Routines with signature, properties, dependencies and cleaned body."""
    ns = scoped(_renamed(x["namespace"], pronamespace="oid", nspname="nspname"), "user_only", schemas)
    lang = _renamed(x["language"], prolang="oid", lanname="lanname")
    # The body is taken before routines move to their dependencies: it is one of two texts, or a part of one.
    body = labels.routine_body("lanname", "prosrc", "functiondef").alias("function_body")
    routines = x["proc"].join(ns, [DB, "pronamespace"]).join(lang, [DB, "prolang"])
    routines = routines.select(*[c for c in routines.columns if c not in ("prosrc", "functiondef")], body)
    return (
        routines.join(agg_function_deps(x), [DB, "oid"], "left")
        .select(
            DB,
            F.col("nspname").alias("schema_name"),
            F.concat(text("proname"), F.lit("("), text("identity_args"), F.lit(")")).alias("function_name"),
            F.col("args").alias("argument_types"),
            F.col("identity_args").alias("argument_modes"),
            "return_type",
            F.col("lanname").alias("language"),
            labels.label("provolatile", labels.VOLATILITY).alias("volatility"),
            labels.label("proparallel", labels.PARALLEL).alias("parallel_safe"),
            F.col("owner").alias("owner_role"),
            F.col("proacl").alias("privileges"),
            "dependencies",
            F.col("prosecdef").alias("is_security_definer"),
            F.array_join("config", ", ").alias("config_settings_text"),
            "function_body",
        )
    )


def fetch_indexes(x: Extracts, entries: Entries = None) -> DataFrame:
    """Indexes of tables and materialized views, key columns in key order."""
    rel = scoped(_relations(x), "index", entries).select(DB, F.col("oid").alias("indrelid"), "nspname", "relname", "relkind")
    own = _renamed(
        _class(x), indexrelid="oid", index_name="relname", relam="relam", reltablespace="reltablespace"
    )
    members = (
        x["index"]
        .select(DB, "indexrelid", F.col("indrelid").alias("attrelid"), F.posexplode("indkey").alias("ord", "attnum"))
        .join(_columns(x), [DB, "attrelid", "attnum"])
        .groupBy(DB, "indexrelid")
        .agg(sorted_list("attname", ",", by="ord").alias("index_columns"))
    )
    return (
        x["index"]
        .join(rel, [DB, "indrelid"])
        .join(own, [DB, "indexrelid"])
        .join(_renamed(x["am"], relam="oid", amname="amname"), [DB, "relam"])
        .join(_renamed(x["tablespace"], reltablespace="oid", spcname="spcname"), [DB, "reltablespace"], "left")
        .join(members, [DB, "indexrelid"], "left")
        .select(
            DB,
            F.col("nspname").alias("schema_name"),
            labels.label("relkind", {"r": "Table", "m": "Materialized View"}).alias("object_type"),
            F.col("relname").alias("object_type_name"),
            "index_name",
            F.col("spcname").alias("tablespace"),
            tighten_parens(collapse_ws("indexdef")).alias("indexdef"),
            F.col("indisunique").alias("is_unique"),
            F.col("indisprimary").alias("is_primary"),
            "index_columns",
            collapse_ws(text("predicate")).alias("index_predicate"),
            F.col("amname").alias("access_method"),
        )
    )


def _every_view_read(x: Extracts) -> DataFrame:
    """Distinct (view, relation it reads) with both kinds, of views and materialized views that read
    tables or one another: ``oid``, ``view_kind``, ``read_kind`` and ``schema.name``."""
    views = (
        _class(x)
        .where(F.col("relkind").isin("v", "m"))
        .select(DB, F.col("oid").alias("ev_class"), F.col("relkind").alias("view_kind"))
    )
    read = _relations(x, F.col("relkind").isin("r", "v", "m")).select(
        DB,
        F.col("oid").alias("refobjid"),
        F.col("relkind").alias("read_kind"),
        F.concat("nspname", F.lit("."), "relname").alias("read_name"),
    )
    rules = _renamed(x["rewrite"], objid="oid", ev_class="ev_class").join(views, [DB, "ev_class"])
    return (
        x["depend"]
        .select(DB, "objid", "refobjid")
        .distinct()
        .join(rules, [DB, "objid"])
        .join(read, [DB, "refobjid"])
        .where(F.col("refobjid") != F.col("ev_class"))
        .select(DB, F.col("ev_class").alias("oid"), "view_kind", "read_kind", "read_name")
        .distinct()
    )


def _view_reads(x: Extracts, view_kinds: tuple[str, ...], read_kinds: tuple[str, ...]) -> DataFrame:
    """Distinct (view, relation it reads) pairs as ``oid`` and ``schema.name``."""
    every = _shared(x, VIEW_READS) if VIEW_READS in x else _every_view_read(x)
    chosen = every.where(F.col("view_kind").isin(*view_kinds) & F.col("read_kind").isin(*read_kinds))
    return chosen.select(DB, "oid", "read_name").distinct()


def agg_base_tables(x: Extracts, view_kind: str) -> DataFrame:
    """Per view of the kind (``v`` or ``m``): the tables it reads, distinct and sorted."""
    return (
        _view_reads(x, (view_kind,), ("r",))
        .groupBy(DB, "oid")
        .agg(sorted_list("read_name", ", ").alias("base_tables"))
    )


def agg_related_views(x: Extracts) -> DataFrame:
    """Per view or materialized view: the other ones it reads, distinct and sorted."""
    return (
        _view_reads(x, ("v", "m"), ("v", "m"))
        .groupBy(DB, "oid")
        .agg(sorted_list("read_name", ", ").alias("dependent_views"))
    )


def agg_view_indexes(x: Extracts) -> DataFrame:
    """Per materialized view: its index names, sorted."""
    views = _class(x).where(F.col("relkind") == "m").select(DB, F.col("oid").alias("indrelid"))
    own = _renamed(_class(x), indexrelid="oid", index_name="relname")
    return (
        x["index"]
        .select(DB, "indrelid", "indexrelid")
        .join(views, [DB, "indrelid"])
        .join(own, [DB, "indexrelid"])
        .groupBy(DB, F.col("indrelid").alias("oid"))
        .agg(sorted_list("index_name", ", ").alias("indexes"))
    )


def agg_instead_triggers(x: Extracts) -> DataFrame:
    """Per view: its INSTEAD OF triggers' names, sorted."""
    views = _class(x).where(F.col("relkind") == "v").select(DB, F.col("oid").alias("tgrelid"))
    return (
        x["trigger"]
        .where(labels.has_bit("tgtype", 64))
        .join(views, [DB, "tgrelid"])
        .groupBy(DB, F.col("tgrelid").alias("oid"))
        .agg(sorted_list("tgname", ", ").alias("triggers"))
    )


def _related_text(title: str, names: str) -> Column:
    return F.concat(F.lit(f"{title}: "), F.col(names))


def fetch_matviews(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Materialized views with what they read, their indexes, owner and populated flag."""
    return (
        scoped(_relations(x, F.col("relkind") == "m", definitions=True), "user_only", schemas)
        .join(agg_base_tables(x, "m"), [DB, "oid"], "left")
        .join(agg_related_views(x), [DB, "oid"], "left")
        .join(agg_view_indexes(x), [DB, "oid"], "left")
        .select(
            DB,
            F.col("nspname").alias("schema_name"),
            F.col("relname").alias("view_name"),
            F.lit("MATERIALIZED VIEW").alias("view_type"),
            collapse_ws("viewdef").alias("view_definition"),
            text("base_tables").alias("base_tables"),
            F.col("relispopulated").alias("is_populated"),
            F.col("relowner").alias("view_owner"),
            F.trim(
                joined(
                    [_related_text("Dependent views", "dependent_views"), _related_text("Indexes", "indexes")],
                    ", ",
                ),
                F.lit(", "),
            ).alias("dependent_objects"),
        )
    )


def fetch_views(x: Extracts, schemas: Entries = None) -> DataFrame:
    """Views with what they read, their INSTEAD OF triggers and owner."""
    return (
        scoped(_relations(x, F.col("relkind") == "v", definitions=True), "user_only", schemas)
        .join(agg_base_tables(x, "v"), [DB, "oid"], "left")
        .join(agg_related_views(x), [DB, "oid"], "left")
        .join(agg_instead_triggers(x), [DB, "oid"], "left")
        .select(
            DB,
            F.col("nspname").alias("schema_name"),
            F.col("relname").alias("view_name"),
            F.lit("VIEW").alias("view_type"),
            F.col("viewdef").alias("view_definition"),
            text("base_tables").alias("base_tables"),
            F.col("relowner").alias("view_owner"),
            F.trim(
                joined(
                    [
                        _related_text("Dependent views", "dependent_views"),
                        _related_text("INSTEAD OF triggers", "triggers"),
                    ],
                    ", ",
                ),
                F.lit(", "),
            ).alias("dependent_objects"),
        )
    )


def fk_pairs(x: Extracts, sources: DataFrame) -> DataFrame:
    """Foreign-key column pairs, matched by position, of the relations in ``sources``
    (``conrelid``, ``nspname``, ``relname``)."""
    target = _relations(x).select(
        DB,
        F.col("oid").alias("confrelid"),
        F.col("nspname").alias("target_schema"),
        F.col("relname").alias("target_table"),
    )
    source_col = _renamed(_columns(x), conrelid="attrelid", src_num="attnum", source_column="attname")
    target_col = _renamed(_columns(x), confrelid="attrelid", tgt_num="attnum", target_column="attname")
    return (
        x["constraint"]
        .where(F.col("contype") == "f")
        .join(sources, [DB, "conrelid"])
        .select(
            DB,
            "nspname",
            "relname",
            "conname",
            "conrelid",
            "confrelid",
            F.explode(F.arrays_zip("conkey", "confkey")).alias("pair"),
        )
        .withColumns({"src_num": F.col("pair.conkey"), "tgt_num": F.col("pair.confkey")})
        .join(source_col, [DB, "conrelid", "src_num"])
        .join(target_col, [DB, "confrelid", "tgt_num"])
        .join(target, [DB, "confrelid"])
        .select(
            DB,
            F.col("nspname").alias("schema_name"),
            F.col("relname").alias("table_name"),
            "source_column",
            "target_schema",
            "target_table",
            "target_column",
            F.col("conname").alias("constraint_name"),
        )
    )


def fetch_references(x: Extracts, entries: Entries = None) -> DataFrame:
    """One row per foreign-key column pair."""
    sources = scoped(_relations(x), "reference", entries)
    return fk_pairs(x, sources.select(DB, F.col("oid").alias("conrelid"), "nspname", "relname"))


def pick_sequence_owner(x: Extracts) -> DataFrame:
    """Per dependent relation: one owner, column owners first, then by column name.

    The smallest struct of the group is a partial aggregate, so no group is sorted in one task.
    """
    owner = _relations(x).select(
        DB,
        F.col("oid").alias("refobjid"),
        F.col("nspname").alias("table_schema"),
        F.col("relname").alias("table_name"),
    )
    column = _columns(x).select(
        DB,
        F.col("attrelid").alias("refobjid"),
        F.col("attnum").cast("int").alias("refobjsubid"),
        F.col("attname").alias("column_name"),
    )
    return (
        x["depend"]
        .where((F.col("classid") == RELATION_CLASS) & (F.col("refclassid") == RELATION_CLASS))
        .join(owner, [DB, "refobjid"])
        .join(column, [DB, "refobjid", "refobjsubid"], "left")
        .groupBy(DB, F.col("objid").alias("seqrelid"))
        .agg(
            F.min(
                F.struct(
                    F.col("column_name").isNull().alias("no_column"),
                    "column_name",
                    "table_schema",
                    "table_name",
                    "deptype",
                )
            ).alias("owner")
        )
        .select(DB, "seqrelid", "owner.table_schema", "owner.table_name", "owner.column_name", "owner.deptype")
    )


def fetch_sequences(x: Extracts, entries: Entries = None) -> DataFrame:
    """Sequences with their owner column, kind and settings."""
    rel = scoped(_relations(x, F.col("relkind") == "S"), "sequence", entries).select(DB, F.col("oid").alias("seqrelid"), "nspname", "relname", "relacl")
    owned_by = F.when(
        F.col("table_name").isNotNull() & F.col("column_name").isNotNull(),
        F.concat_ws(
            ".", *[labels.quoted_ident(c) for c in ("table_schema", "table_name", "column_name")]
        ),
    )
    return (
        x["sequence"]
        .join(rel, [DB, "seqrelid"])
        .join(pick_sequence_owner(x), [DB, "seqrelid"], "left")
        .select(
            DB,
            F.col("nspname").alias("schema_name"),
            F.lit("Sequence").alias("object_type"),
            F.col("relname").alias("object_type_name"),
            "table_name",
            owned_by.alias("owned_by"),
            labels.label("deptype", labels.OWNERSHIP, "'MANUAL'").alias("sequence_type"),
            F.col("relacl").alias("privileges"),
            F.col("type_name").alias("data_type"),
            F.col("seqstart").alias("start_value"),
            F.col("seqmin").alias("minimum_value"),
            F.col("seqmax").alias("maximum_value"),
            F.col("seqincrement").alias("increment_by"),
            F.when(F.col("seqcycle"), F.lit("YES")).otherwise(F.lit("NO")).alias("cycle_option"),
            F.col("seqcache").alias("cache_size"),
        )
    )


def fetch_triggers(x: Extracts, entries: Entries = None, *, corrected: bool = False) -> DataFrame:
    """Triggers that users made; ``corrected`` reads the type bits as the server sets them."""
    rel = scoped(_relations(x), "trigger", entries).select(
        DB, F.col("oid").alias("tgrelid"), "nspname", "relname", "relkind"
    )
    return (
        x["trigger"]
        .where(~F.col("tgisinternal"))
        .join(rel, [DB, "tgrelid"])
        .select(
            DB,
            F.col("nspname").alias("schema_name"),
            F.when(F.col("relkind") == "v", F.lit("View")).otherwise(F.lit("Table")).alias("object_type"),
            F.col("relname").alias("object_type_name"),
            F.col("tgname").alias("trigger_name"),
            collapse_ws("triggerdef").alias("trigger_definition"),
            labels.trigger_event("tgtype", corrected=corrected).alias("trigger_event"),
            labels.trigger_timing("tgtype", corrected=corrected).alias("trigger_timing"),
            labels.trigger_level("tgtype").alias("trigger_level"),
            (F.col("tgenabled") == "O").alias("trigger_enabled"),
            F.col("function_name").alias("trigger_function_name"),
            F.col("function_args").alias("trigger_function_arguments"),
            collapse_ws("functiondef").alias("trigger_function_definition"),
        )
    )
