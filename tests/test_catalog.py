"""Catalog assembly and fingerprints on small hand-made extracts."""

from __future__ import annotations

import time

import hashlib

import pytest
from pyspark.sql import functions as F

from driftmark.functions import canon, labels
from driftmark.operators import assembly, fingerprints, scope
from driftmark.schemas import EXTRACT_SCHEMAS, with_db
from driftmark.sources.extracts import combine_databases, read_extracts, write_extracts

ROWS = {
    "namespace": [(1, "app"), (2, "pg_catalog"), (3, "Odd")],
    "class": [
        (10, 1, "orders", "r", 0, 0, None, "ann", True, None),
        (11, 1, "items", "r", 0, 0, None, "ann", True, None),
        (12, 1, "v1", "v", 0, 0, None, "bob", True, "SELECT\n  1"),
        (13, 1, "m1", "m", 0, 0, None, None, False, "SELECT\n  2"),
        (14, 1, "seq_owned", "S", 0, 0, "{ann=U}", "ann", True, None),
        (15, 3, "seq_free", "S", 0, 0, None, "ann", True, None),
        (16, 2, "sys", "r", 0, 0, None, "ann", True, None),
        (17, 1, "parted", "p", 0, 0, None, "ann", True, None),
        (18, 3, "Order", "r", 0, 0, None, "ann", True, None),
        (20, 1, "ix_b", "i", 90, 91, None, "ann", True, None),
        (21, 1, "ix_a", "i", 90, 0, None, "ann", True, None),
    ],
    "attribute": [
        (10, 1, "id", 100, -1, True, False),
        (10, 2, "code", 101, 24, False, False),
        (10, 3, "gone", 101, -1, False, True),
        (10, -1, "ctid", 100, -1, False, False),
        (10, 4, "price", 102, 655366, False, False),
        (10, 5, "free", 102, -1, False, False),
        (11, 1, "order_code", 101, -1, False, False),
        (11, 2, "order_id", 100, -1, True, False),
        (12, 1, "c", 103, -1, False, False),
        (16, 1, "x", 100, -1, False, False),
        (17, 1, "y", 100, -1, False, False),
        (18, 1, "select", 100, -1, False, False),
    ],
    "type": [(100, "int4"), (101, "varchar"), (102, "numeric"), (103, "timestamptz")],
    "attrdef": [(10, 1, "nextval('seq_owned')")],
    "constraint": [
        (30, "pk", 10, "p", [1], 0, None, "PRIMARY  KEY (id)"),
        (31, "uq", 10, "u", [2, 1], 0, None, "UNIQUE (code, id)"),
        (32, "fk", 11, "f", [2, 1], 10, [1, 2], "FOREIGN KEY (order_id, order_code)"),
        (33, "ck", 10, "c", [4], 0, None, "CHECK (price\n > 0)"),
        (34, "ex", 10, "x", [4], 0, None, "EXCLUDE"),
    ],
    "proc": [
        (40, 1, "f", 1, "i", "s", "ann", None, False, None, "a int", "int", "int", "  SELECT\n 1  ", ""),
        (41, 1, "g", 2, "v", "u", "ann", "{x}", True, ["a=1", "b=2"], "", "", "void", "",
         "CREATE FUNCTION g()\nAS $function$\nbegin\n  x := 1;\n  RETURN  x;\nend;\n$function$\n"),
        (42, 2, "sys", 1, "i", "s", "ann", None, False, None, "", "", "int", "", ""),
    ],
    "language": [(1, "sql"), (2, "plpgsql")],
    "depend": [
        (1255, 40, 1259, 11, 0, "items", "n"),
        (1255, 40, 1247, 99, 0, "99", "n"),
        (1255, 40, 1259, 10, 0, "orders", "n"),
        (2618, 50, 1259, 10, 1, None, "n"),
        (2618, 50, 1259, 10, 2, None, "n"),
        (2618, 50, 1259, 13, 1, None, "n"),
        (2618, 50, 1259, 12, 0, None, "i"),
        (2618, 51, 1259, 11, 1, None, "n"),
        (1259, 14, 1259, 11, 0, None, "n"),
        (1259, 14, 1259, 10, 1, None, "a"),
    ],
    "rewrite": [(50, 12), (51, 13)],
    "index": [
        (20, 10, [2, 1], True, False, "CREATE INDEX ix_b  ON orders ( code, id )", "(id  > 1)"),
        (21, 13, [1], False, False, "CREATE INDEX ix_a ON m1 (c)", None),
    ],
    "am": [(90, "btree")],
    "tablespace": [(91, "fast")],
    "sequence": [(14, 1, 1, 99, 1, 1, False, "bigint"), (15, 1, 1, 99, 2, 1, True, "integer")],
    "trigger": [
        (60, 10, "trg", 5, "O", False, "CREATE  TRIGGER trg", "audit", "", "CREATE\nFUNCTION audit"),
        (61, 10, "internal", 5, "O", True, "x", "audit", "", ""),
        (62, 12, "ins", 64, "D", False, "y", "audit", "", ""),
    ],
    "schemata": [("app",), ("pg_catalog",), ("pgdata",), ("pg_temp",), ("information_schema",), ("own",)],
}


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def x(spark):
    frames = {n: spark.createDataFrame(rows, EXTRACT_SCHEMAS[n]) for n, rows in ROWS.items()}
    return combine_databases({"db": frames})


def by(df, key):
    return {r[key]: r for r in df.collect()}


def test_columns(x):
    found = by(assembly.fetch_columns(x), "column_name")
    assert set(found) == {"id", "code", "price", "free", "order_code", "order_id", "c", "select"}
    assert found["id"].constraint_name == "pk,uq" and found["id"].data_type == "integer"
    assert (found["id"].numeric_precision, found["id"].numeric_scale, found["id"].is_nullable) == (32, 0, "NO")
    assert found["code"].character_maximum_length == 20 and found["order_code"].character_maximum_length == -5
    assert (found["price"].numeric_precision, found["price"].numeric_scale) == (10, 2)
    assert (found["free"].numeric_precision, found["free"].numeric_scale) == (65535, 65531)
    assert (found["c"].object_type, found["c"].data_type) == ("View", "timestamp with time zone")
    listed = assembly.fetch_columns(x, ["pg_catalog"])
    assert [r.column_name for r in listed.collect()] == ["x"]
    assert assembly.fetch_columns(x, []).isEmpty()


def test_column_fingerprint(x):
    row = by(fingerprints.fp_columns(x), "object_subtype_name")["id"]
    details = (
        "data_type:integer,max_length:,numeric_precision:32,numeric_scale:0,nullable:NO,"
        "default_value:nextval('seq_owned'),is_identity:NO,is_generated:NEVER,generation_expression:,"
        "constraint_name:pk,uq,ordinal_position:1"
    )
    assert (row.object_subtype_details, row.object_md5) == (details, md5(details))


def test_constraints(x):
    found = by(assembly.fetch_constraints(x), "constraint_name")
    assert {n: (r.constraint_type, r.column_name) for n, r in found.items()} == {
        "pk": ("PRIMARY KEY", "id"),
        "uq": ("UNIQUE", "id,code"),
        "fk": ("FOREIGN KEY", "order_code,order_id"),
        "ck": ("CHECK", None),
        "ex": ("x", None),
    }
    row = by(fingerprints.fp_constraints(x), "object_subtype_name")["ck"]
    details = "constraint_type:CHECK,column_name:,definition:CHECK (price > 0)"
    assert row.object_subtype_details == details
    assert row.object_md5 == md5(f"schema:app:table:orders:constraint:ck:{details}")


def test_functions(x):
    found = by(assembly.fetch_functions(x), "function_name")
    assert set(found) == {"f(int)", "g()"}
    assert found["f(int)"].dependencies == "99,orders,items"
    assert found["f(int)"].function_body == "SELECT 1"
    assert (found["f(int)"].volatility, found["f(int)"].parallel_safe) == ("IMMUTABLE", "SAFE")
    assert found["g()"].function_body == "begin x := 1;"
    assert found["g()"].config_settings_text == "a=1, b=2"
    details = by(fingerprints.fp_functions(x), "object_type_name")["g()"].object_subtype_details
    assert "privileges:{x},dependencies:,function_body:begin x := 1;" in details


@pytest.mark.parametrize(
    ("definition", "body"),
    [
        ("AS $$ DECLARE a int; BEGIN b; END $$ LANGUAGE x", "DECLARE a int; BEGIN b; "),
        ("AS $$ BEGIN IF a THEN RETURN 1; END IF; RETURN 2; END; $$", "BEGIN IF a THEN RETURN 1; END IF;"),
        ("AS $$\nBEGIN\n\tPERFORM x();\nEND\n$$;\n", "BEGIN PERFORM x(); "),
        ("no block at all", "no block at all"),
    ],
)
def test_procedural_bodies(spark, definition, body):
    df = spark.createDataFrame([("plpgsql", None, definition)], "l string, s string, d string")
    assert df.select(labels.routine_body("l", "s", "d")).first()[0].rstrip() == body.rstrip()


def test_indexes(x):
    row = by(assembly.fetch_indexes(x), "index_name")["ix_b"]
    assert row.indexdef == "CREATE INDEX ix_b ON orders (code, id)"
    assert (row.index_columns, row.index_predicate, row.tablespace, row.access_method) == (
        "code,id",
        "(id > 1)",
        "fast",
        "btree",
    )
    printed = by(fingerprints.fp_indexes(x), "object_subtype_name")["ix_b"]
    assert printed.object_md5 == md5(
        "tablespace:fast:indexdef:CREATE INDEX ix_b ON orders (code, id):is_unique:true:is_primary:false"
        ":index_columns:code,id:index_predicate:(id > 1):access_method:btree"
    )


def test_views_list_what_they_read(x):
    view = assembly.fetch_views(x).first()
    assert view.base_tables == "app.orders" and view.view_definition == "SELECT\n  1"
    assert view.dependent_objects == "Dependent views: app.m1, INSTEAD OF triggers: ins"
    matview = assembly.fetch_matviews(x).first()
    assert matview.base_tables == "app.items" and matview.view_definition == "SELECT 2"
    assert matview.dependent_objects == "Indexes: ix_a"


def test_matview_drops_a_null_part_whole(x):
    row = fingerprints.fp_matviews(x).first()
    assert "view_owner" not in row.object_subtype_details
    assert row.object_md5 == md5("MATERIALIZED VIEW:SELECT 2:app.items:false:Indexes: ix_a")


def test_references_sort_each_side_on_its_own(x):
    pairs = sorted((r.source_column, r.target_column) for r in assembly.fetch_references(x).collect())
    assert pairs == [("order_code", "code"), ("order_id", "id")]
    row = fingerprints.fp_references(x).first()
    assert row.object_subtype_details == (
        "source_columns:{order_code,order_id},target_schema:app,target_table:orders,"
        "target_columns:{code,id},constraint_name:fk"
    )
    assert row.object_md5 == md5("src:order_code,order_id tgt:code,id tbl:items ref:orders cons:fk")


def test_sequences(x):
    found = by(assembly.fetch_sequences(x), "object_type_name")
    assert (found["seq_owned"].owned_by, found["seq_owned"].sequence_type) == ("app.orders.id", "SERIAL")
    assert (found["seq_free"].owned_by, found["seq_free"].sequence_type) == (None, "MANUAL")
    printed = by(fingerprints.fp_sequences(x), "schema_name")
    assert (printed["app"].object_type, printed["app"].object_type_name, printed["app"].object_subtype_name) == (
        "Table",
        "orders",
        "seq_owned",
    )
    assert (printed["Odd"].object_type, printed["Odd"].object_subtype) == ("Sequence", None)
    assert printed["Odd"].object_md5 == md5(":MANUAL::integer:1:1:99:2:YES:1")


def test_triggers(x):
    row = by(fingerprints.fp_triggers(x), "object_subtype_name")["trg"]
    details = (
        "trigger_definition:CREATE TRIGGER trg,trigger_event:DELETE,trigger_timing:BEFORE,trigger_level:ROW,"
        "trigger_enabled:true,trigger_function_name:audit,trigger_function_arguments:,"
        "trigger_function_definition:CREATE FUNCTION audit"
    )
    assert row.object_subtype_details == details
    assert row.object_md5 == md5(f"app||Table||orders||Trigger||trg||{details}")
    found = by(assembly.fetch_triggers(x), "trigger_name")
    assert set(found) == {"trg", "ins"} and found["ins"].object_type == "View"


def test_trigger_bits(spark):
    bits = spark.createDataFrame([(b,) for b in (1, 2, 4, 5, 7, 8, 16, 29, 64)], "b int")
    rows = bits.select(
        "b", labels.trigger_timing("b").alias("t"), labels.trigger_event("b").alias("e"),
        labels.trigger_level("b").alias("l"), labels.trigger_timing("b", corrected=True).alias("ct"),
        labels.trigger_event("b", corrected=True).alias("ce"),
    )
    assert {r.b: (r.t, r.e, r.l) for r in rows.collect()} == {
        1: (None, "UNKNOWN", "ROW"),
        2: (None, "INSERT", "STATEMENT"),
        4: ("BEFORE", "DELETE", "STATEMENT"),
        5: ("BEFORE", "DELETE", "ROW"),
        7: ("BEFORE", "INSERT", "ROW"),
        8: ("AFTER", "UPDATE", "STATEMENT"),
        16: ("INSTEAD OF", "UNKNOWN", "STATEMENT"),
        29: ("BEFORE", "DELETE", "ROW"),
        64: (None, "UNKNOWN", "STATEMENT"),
    }
    assert {r.b: (r.ct, r.ce) for r in rows.collect() if r.b in (7, 64)} == {
        7: ("BEFORE", "INSERT"),
        64: ("INSTEAD OF", "UNKNOWN"),
    }


def test_quoted_identifiers(spark):
    names = ["plain_1", "Upper", "select", "user", "a$b", 'q"q', "1st", "name", "_x"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(labels.quoted_ident("n")).collect()] == [
        "plain_1", '"Upper"', '"select"', '"user"', '"a$b"', '"q""q"', '"1st"', "name", "_x",
    ]


def test_scope_lists(x):
    def names(df):
        return sorted(r.schema_name for r in df.collect())

    schemata = x["schemata"]
    assert names(scope.scope_include(schemata, ["app", "x"])) == ["app"]
    assert names(scope.scope_include(schemata, None)) == []
    assert names(scope.scope_effective(schemata, "own")) == ["app"], "pgdata matches the wildcard"
    assert names(scope.scope_exclude(schemata, ["app"], "own")) == []
    assert names(scope.scope_exclude(schemata, None, "own")) == []


def test_scope_three_way_edges(x):
    def references(entries):
        return assembly.fetch_references(x, entries).count()

    assert references([]) == references(None) == references(["app"]) == references(["app.items"]) == 2
    assert references(["app", "other.t"]) == 0, "a dotted entry turns plain ones off"
    assert assembly.fetch_indexes(x, []).count() == 2
    assert assembly.fetch_constraints(x, []).isEmpty()
    assert assembly.fetch_constraints(x, ["app.items.more"]).count() == 1
    assert assembly.fetch_triggers(x, ["app.v1"]).count() == 1
    assert assembly.fetch_sequences(x, ["Odd.seq_free"]).count() == 1
    with pytest.raises(ValueError, match="unknown scope"):
        scope.scope_three_way("other", None, "a", "b")


def test_unions(x):
    children = fingerprints.union_child(x).groupBy("object_subtype").count().collect()
    assert {r.object_subtype: r["count"] for r in children} == {
        "Column": 8, "Constraint": 5, "Index": 2, "Reference": 1, "Trigger": 2, "Sequence": 1,
    }
    entities = fingerprints.union_entity(x).groupBy("object_type").count().collect()
    assert {r.object_type: r["count"] for r in entities} == {
        "Function": 2, "View": 1, "Materialized View": 1, "Sequence": 1,
    }
    assert fingerprints.union_current(x).count() == 19 + 5


def test_settled_unions(spark, x, tmp_path):
    def settle(name, df):
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    def rows(df):
        return sorted(map(str, df.collect()))

    # Stored, so that a plan names what it reads; repeated rows of an extract give no repeated result.
    twice = {name: df.unionByName(df) if name in ("trigger", "namespace", "rewrite") else df for name, df in x.items()}
    for n, extracts in enumerate((x, twice)):
        for union in (fingerprints.union_child, fingerprints.union_entity, fingerprints.union_current):
            assert rows(union(extracts, settle=settle)) == rows(union(extracts)), (n, union)
    assert rows(fingerprints.union_current(x, ["app"], settle=settle)) == rows(fingerprints.union_current(x, ["app"]))


def test_settled_plan(spark, x, tmp_path):
    plans = {}

    def settle(name, df):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    stored = {name: settle(f"extract-{name}", df) for name, df in x.items()}
    plans.clear()
    plans["result"] = fingerprints.union_current(stored, settle=settle)._jdf.queryExecution().executedPlan().toString()
    scans = [line for text in plans.values() for line in text.splitlines() if "extract-class" in line]
    assert len(scans) == 3, "relations, and the definitions of views and of materialized views"
    assert not any("viewdef" in line for line in plans["current-settled_relations"].splitlines() if "extract-class" in line)
    wide = "object_subtype_details"
    assert not any("Exchange hash" in line and wide in line for line in plans["current-repeated"].splitlines())


def test_floats_are_refused(spark):
    df = spark.createDataFrame([(1, 0.1)], "k int, v double")
    with pytest.raises(ValueError, match="cast v"):
        fingerprints.fp_table(df, {"object_type": "T"}, {"v": F.col("v")})


def test_canonical_text(spark):
    df = spark.createDataFrame([("a  b\n c", None, "x" * 95)], "s string, n string, l string")
    row = df.select(
        canon.collapse_ws("s"), canon.kv("k", "n"), canon.kv_if_set("k", "n"), canon.preview("l"),
        canon.joined([canon.kv_if_set("k", "n"), canon.kv("s", "s")], ","),
    ).first()
    assert list(row) == ["a b c", "k:", None, "x" * 90 + "...", "s:a  b\n c"]


def test_extracts_are_read_per_database(spark, x, tmp_path):
    both = combine_databases({"one": {"namespace": x["namespace"]}, "two": {"namespace": x["namespace"].limit(1)}})
    write_extracts(both, str(tmp_path))
    one = read_extracts(spark, str(tmp_path), ["one"], ["namespace"])["namespace"]
    assert one.schema == with_db(EXTRACT_SCHEMAS["namespace"]) or set(one.columns) == {"source_db", "oid", "nspname"}
    assert one.count() == 3 and read_extracts(spark, str(tmp_path), None, ["namespace"])["namespace"].count() == 4
    assert "PartitionFilters: [source_db" in one._jdf.queryExecution().toString().replace("isnotnull(", "")


@pytest.mark.parametrize("variant", ["constraint", "index", "reference", "sequence", "trigger", "system_default", "user_only"])
@pytest.mark.parametrize("entries", [[], ["app"], ["app", "pg_catalog"], ["app.t", "x"], ["app.t.u"], ["app.t", "app"], ["x"]])
def test_a_scope_relation_keeps_what_the_list_keeps(spark, variant, entries):
    rows = [(s, n, k) for s in ("app", "x", "pg_catalog", "app.t", None) for n in ("t", "u", "t.u", None) for k in "rmvS"]
    rel = spark.createDataFrame(rows, "nspname string, relname string, relkind string")
    relation = spark.createDataFrame([(e,) for e in [*entries, *entries, None]], "entry string")
    by_list, by_relation = (sorted(map(repr, scope.scoped(rel, variant, e).collect())) for e in (entries, relation))
    assert by_list == by_relation


def test_ten_thousand_entries_are_planned_at_once(spark, x):
    entries = spark.range(10_000).selectExpr("concat('app.t', id) as entry").unionByName(spark.createDataFrame([("app",)], "entry string"))
    started = time.monotonic()
    plans = [f(x, entries)._jdf.queryExecution().executedPlan().toString() for f in (assembly.fetch_constraints, assembly.fetch_indexes, assembly.fetch_triggers)]
    assert time.monotonic() - started < 3 * 2
    assert all(len(p) < 100_000 and "NestedLoop" not in p and "Cartesian" not in p for p in plans)
    schemata = x["schemata"]
    for found in (scope.scope_include(schemata, entries), scope.scope_exclude(schemata, entries, "own")):
        assert len(found._jdf.queryExecution().executedPlan().toString()) < 20_000
    assert [r.schema_name for r in scope.scope_include(schemata, entries).collect()] == ["app"]


def test_settled_parts_are_not_gathered_on_the_driver(spark, x, tmp_path):
    """Shared relations and columns look small by their files, and are many rows."""
    plans = {}

    def settle(name, df):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{tmp_path}/{name}")

    fingerprints.union_current(x, settle=settle)
    assert plans["current-rows"].count("strategy=merge") >= 10


def test_whole_rows_move_only_where_some_repeat(spark, x):
    """A distinct over the union would shuffle every body and definition."""
    for union in (fingerprints.union_child, fingerprints.union_entity, fingerprints.union_current):
        assert union(x)._jdf.queryExecution().optimizedPlan().nodeName() == "Union"
        twice = {name: df.unionByName(df) if name in ("trigger", "namespace", "rewrite") else df for name, df in x.items()}
        found, every = (sorted(map(str, rows.collect())) for rows in (union(twice), union(twice, distinct=False)))
        assert found == sorted(set(every)) and len(found) < len(every)
    # Equal rows that differ in their identity's nulls alone count as equal, as in a distinct.
    row = ("a", "s", None, "t", "Column", None, "d", "m")
    rows = spark.createDataFrame([row, row], "source_db string, schema_name string, object_type string, object_type_name string, "
                                 "object_subtype string, object_subtype_name string, object_subtype_details string, object_md5 string")  # fmt: skip
    assert fingerprints._distinct_union([rows.limit(1), rows.limit(1)]).count() == 1


def test_a_routines_body_moves_once(spark, x):
    """Routines move to their dependencies with their body, not with both texts it may come from."""
    node = assembly.fetch_functions(x)._jdf.queryExecution().optimizedPlan()
    while node.nodeName() != "Join":
        node = node.children().head()
    left = node.children().head().output()
    names = {left.apply(i).name() for i in range(left.size())}
    assert "function_body" in names and not names & {"prosrc", "functiondef"}
