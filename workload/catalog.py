"""Catalog extracts derived from the given tables; catalog_sql holds the same derivations as SQL.

Ids are spread over all relations by row number, so the lists that end up in one text cell
(columns of an index, tables of a view, ...) stay short whatever the data's own key skew is.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.schemas import DB, EXTRACT_SCHEMAS
from driftmark.sources.extracts import LazyExtracts
from workload.states import table

RELKIND = "CASE p_partkey % 10 WHEN 7 THEN 'v' WHEN 8 THEN 'm' WHEN 9 THEN 'S' ELSE 'r' END"


class _Derived:
    """The derivations of one catalog state: a method per extract relation. ``n`` is the number
    of parts, so every derived id of a relation falls on one."""

    def __init__(self, spark: SparkSession, sf: str, side: str):
        self.spark = spark
        self.sf = sf
        self.current = side == "current"
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str, *, sized_by: str | None = None) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = table(self.spark, self.sf, name)
        df = self._tables[name]
        if sized_by is None:
            return df
        return df.withColumn("n", self.table(sized_by).select(F.count(F.lit(1))).scalar())

    def when_current(self, condition: str, then: str, otherwise: str) -> str:
        return f"CASE WHEN {condition} THEN {then} ELSE {otherwise} END" if self.current else otherwise

    def schemata(self) -> DataFrame:
        return self.namespace().selectExpr("nspname as schema_name")

    def namespace(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "n_nationkey as oid",
            "CASE n_nationkey WHEN 24 THEN 'pg_catalog' WHEN 23 THEN 'information_schema' ELSE n_name END as nspname",
        )

    def relations(self) -> DataFrame:
        """Tables, views, materialized views and sequences from parts, indexes from customers."""
        new = self.when_current("p_partkey % 20 = 3", "'_new'", "''")
        shift = self.when_current("p_partkey % 20 = 2", "1", "0")
        from_parts = (
            self.table("part")
            .where(f"p_partkey % 20 <> {1 if self.current else 0}")
            .selectExpr(
                "p_partkey as oid",
                "p_partkey % 25 as relnamespace",
                f"concat('t_', p_partkey, {new}) as relname",
                f"{RELKIND} as relkind",
                "0 as relam",
                "0 as reltablespace",
                "CASE WHEN p_partkey % 3 = 0 THEN concat('{', p_brand, '=r/admin}') END as relacl",
                f"concat('owner_', (p_size + {shift}) % 5) as relowner",
                "p_size % 2 = 0 as relispopulated",
                "CASE WHEN p_partkey % 10 IN (7, 8) "
                "THEN concat(' SELECT  ', p_name, '\n   FROM ', p_type, ';') END as viewdef",
            )
        )
        from_customers = self.table("customer", sized_by="part").selectExpr(
            "1000000000 + c_custkey as oid",
            "(c_custkey % n) % 25 as relnamespace",
            "concat('ix_', c_custkey) as relname",
            "'i' as relkind",
            "c_nationkey % 5 as relam",
            "c_custkey % 7 as reltablespace",
            "NULL as relacl",
            "'admin' as relowner",
            "true as relispopulated",
            "NULL as viewdef",
        )
        return from_parts.unionByName(from_customers)

    def attribute(self) -> DataFrame:
        new = self.when_current("first_order % 20 = 3", "'_new'", "''")
        wider = self.when_current("first_order % 20 = 2", "5", "0")
        return (
            self.table("lineitem")
            .groupBy("l_partkey", "l_linenumber")
            # Whether the greatest flag is R, by numbers: a text's maximum would be found by sorting all lines.
            .agg(
                F.min("l_orderkey").alias("first_order"),
                F.max(F.expr("l_returnflag = 'R'")).alias("any_r"),
                F.max(F.expr("l_returnflag > 'R'")).alias("beyond_r"),
            )
            .selectExpr(
                "l_partkey as attrelid",
                "l_linenumber as attnum",
                f"concat('c_', first_order, '_', l_linenumber, {new}) as attname",
                "(first_order + l_linenumber) % 6 as atttypid",
                f"CASE (first_order + l_linenumber) % 6 WHEN 0 THEN 4 + 10 * l_linenumber + {wider} "
                f"WHEN 3 THEN 655366 + {wider} ELSE -1 END as atttypmod",
                "any_r AND NOT beyond_r as attnotnull",
                "first_order % 37 = 0 as attisdropped",
            )
        )

    def type(self) -> DataFrame:
        names = ("varchar", "int4", "int8", "numeric", "timestamptz", "text")
        # Of a size that Spark knows; else all columns are sorted by their type, which is one of six.
        rows = ", ".join(f"({i}L, '{name}')" for i, name in enumerate(names))
        return self.spark.sql(f"SELECT * FROM VALUES {rows} AS t(oid, typname)")

    def attrdef(self) -> DataFrame:
        """Defaults of columns of every number: a sequence's for the second, a value for a third of the rest."""
        numbered = self.table("lineitem").where("l_linenumber = 2 OR (l_partkey + l_linenumber) % 3 = 0")
        return numbered.select("l_partkey", "l_linenumber").distinct().selectExpr(
            "l_partkey as adrelid",
            "l_linenumber as adnum",
            "CASE WHEN l_linenumber = 2 THEN concat('nextval(\\'s_', l_partkey, '\\')') "
            "ELSE concat('val_', (l_partkey * l_linenumber) % 11) END as default_expr",
        )

    def constraint(self) -> DataFrame:
        return self.table("orders", sized_by="part").selectExpr(
            "o_orderkey as oid",
            "concat('con_', o_orderkey) as conname",
            "o_orderkey % n as conrelid",
            "CASE WHEN o_orderkey % 4 = 0 THEN 'p' WHEN o_orderkey % 4 = 1 THEN 'u' WHEN o_orderkey % 4 = 2 THEN 'f' "
            "WHEN o_orderkey % 8 = 3 THEN 'c' ELSE 'x' END as contype",
            "CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 < 3 THEN array(1L, 2 + o_orderkey % 3) "
            "ELSE array(1L) END as conkey",
            "CASE WHEN o_orderkey % 4 = 2 THEN (o_orderkey * 7 + 3) % n ELSE 0 END as confrelid",
            "CASE WHEN o_orderkey % 4 = 2 AND o_orderkey % 5 = 0 THEN array(2, 1) "
            "WHEN o_orderkey % 4 = 2 THEN array(2) END as confkey",
            "concat('CHECK  (price\n > ', o_orderkey, ')') as definition",
        )

    def proc(self) -> DataFrame:
        """Routines whose bodies are whole documents."""
        return self.table("documents").selectExpr(
            "doc_id as oid",
            "doc_id % 25 as pronamespace",
            "concat('f_', doc_id) as proname",
            "doc_id % 3 as prolang",
            "substr('isvx', cast(doc_id % 4 as int) + 1, 1) as provolatile",
            "substr('rsux', cast(doc_id % 4 as int) + 1, 1) as proparallel",
            "concat('owner_', lang) as owner",
            "CASE WHEN doc_id % 3 = 0 THEN concat('{', source, '=X}') END as proacl",
            "doc_id % 2 = 0 as prosecdef",
            "CASE WHEN doc_id % 5 = 0 THEN array('work_mem=1', concat('lang=', lang)) END as config",
            "concat('a integer, b ', lang) as args",
            "concat('integer, ', lang) as identity_args",
            "'void' as return_type",
            "concat('  ', text, '  ') as prosrc",
            "concat('CREATE FUNCTION f()\n AS $function$ DECLARE x int; BEGIN ', text, "
            "';\n RETURN  x; END;\n $function$') as functiondef",
        )

    def language(self) -> DataFrame:
        return self.table("region").selectExpr(
            "r_regionkey as oid",
            "CASE r_regionkey WHEN 0 THEN 'sql' WHEN 1 THEN 'plpgsql' ELSE concat('lang_', r_regionkey) END as lanname",
        )

    def depend(self) -> DataFrame:
        """Dependencies of routines (orders), view rules and sequences (lineitem)."""
        line = self.table("lineitem", sized_by="part").withColumn("rel", F.expr("l_orderkey % n"))
        of_routines = self.table("orders", sized_by="documents").selectExpr(
            "1255 as classid",
            "o_orderkey % n as objid",
            "CASE WHEN o_orderkey % 3 = 0 THEN 1259 ELSE 1247 END as refclassid",
            "o_orderkey as refobjid",
            "o_orderkey % 4 as refobjsubid",
            "concat('t_', o_orderkey) as ref_name",
            "'n' as deptype",
        )
        of_rules = line.where("rel % 10 IN (7, 8)").selectExpr(
            "2618 as classid",
            "2000000000 + rel as objid",
            "1259 as refclassid",
            "(l_orderkey * 7 + l_linenumber * 13) % n as refobjid",
            "l_linenumber as refobjsubid",
            "NULL as ref_name",
            "'n' as deptype",
        )
        of_sequences = line.where("rel % 20 = 9").selectExpr(
            "1259 as classid",
            "rel as objid",
            "1259 as refclassid",
            "(l_orderkey * 3 + l_linenumber) % n as refobjid",
            "l_linenumber - 1 as refobjsubid",
            "NULL as ref_name",
            "CASE l_linenumber % 3 WHEN 0 THEN 'i' WHEN 1 THEN 'a' ELSE 'n' END as deptype",
        )
        return of_routines.unionByName(of_rules).unionByName(of_sequences)

    def rewrite(self) -> DataFrame:
        views = self.table("part").where("p_partkey % 10 IN (7, 8)")
        return views.selectExpr("2000000000 + p_partkey as oid", "p_partkey as ev_class")

    def index(self) -> DataFrame:
        return self.table("customer", sized_by="part").selectExpr(
            "1000000000 + c_custkey as indexrelid",
            "c_custkey % n as indrelid",
            "array(4 + c_custkey % 2, c_custkey % 3) as indkey",
            "c_custkey % 2 = 0 as indisunique",
            "c_custkey % 5 = 0 as indisprimary",
            "concat('CREATE INDEX  ix_', c_custkey, ' ON\n t ( a,  b )') as indexdef",
            "CASE WHEN c_custkey % 4 = 0 THEN concat('(a  >  ', c_custkey, ')') END as predicate",
        )

    def am(self) -> DataFrame:
        return self.table("region").selectExpr("r_regionkey as oid", "concat('am_', r_regionkey) as amname")

    def tablespace(self) -> DataFrame:
        return self.table("region").selectExpr("r_regionkey as oid", "concat('ts_', r_regionkey) as spcname")

    def sequence(self) -> DataFrame:
        return self.table("part").where("p_partkey % 10 = 9").selectExpr(
            "p_partkey as seqrelid",
            "1 as seqstart",
            "1 as seqmin",
            "p_size * 1000 as seqmax",
            "1 + p_size % 3 as seqincrement",
            "1 as seqcache",
            "p_size % 2 = 0 as seqcycle",
            "lower(p_type) as type_name",
        )

    def trigger(self) -> DataFrame:
        return self.table("events", sized_by="part").selectExpr(
            "event_id as oid",
            "event_id % n as tgrelid",
            "concat('trg_', event_id) as tgname",
            "(event_id * 3) % 128 as tgtype",
            "CASE WHEN event_type = 'error' THEN 'D' ELSE 'O' END as tgenabled",
            "event_id % 11 = 0 as tgisinternal",
            "concat('CREATE  TRIGGER trg_', event_id, '\n ON ', event_type) as triggerdef",
            "concat('fn_', user_id % 10) as function_name",
            "'' as function_args",
            "concat('CREATE  FUNCTION\n ', props) as functiondef",
        )


def extracts(spark: SparkSession, sf: str, side: str = "current", db: str = "main") -> LazyExtracts:
    """All extract relations of one database; ``side`` applies the rule of workload.states to
    relations (by part number) and columns (by order number)."""
    derived = _Derived(spark, sf, side)

    def build(name: str) -> DataFrame:
        df = getattr(derived, "relations" if name == "class" else name)()
        fields = EXTRACT_SCHEMAS[name].fields
        return df.selectExpr(
            f"'{db}' as {DB}", *[f"cast({f.name} as {f.dataType.simpleString()}) as {f.name}" for f in fields]
        )

    return LazyExtracts({name: partial(build, name) for name in EXTRACT_SCHEMAS})
