"""Shape of the plans: what is read, what is shuffled, and how a hot key is handled."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from helpers import child
from pyspark.sql import functions as F

from driftmark.operators import diff, fingerprints, reports, routing
from driftmark.schemas import CHILD_KEYS, FINGERPRINT_SCHEMA
from workload import q_diff
from workload.catalog import extracts


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("states"))
    for side, shift in (("current", 1), ("previous", 0)):
        rows = spark.range(4000).selectExpr(
            "concat('s', id % 3)", "'Table'", "concat('t', id % 50)", "'Column'", "concat('c', id)",
            "repeat(cast(id as string), 20)", f"md5(cast(id + {shift} * (id % 100 = 0) :: int as string))",
        ).toDF(*FINGERPRINT_SCHEMA.names)
        rows.write.parquet(f"{root}/{side}")
    return tuple(spark.read.schema(FINGERPRINT_SCHEMA).parquet(f"{root}/{s}") for s in ("current", "previous"))


def test_keys_are_compared_without_the_details(stored):
    text = plan(diff.locate(*stored, list(CHILD_KEYS), collision_safe=False))
    assert "object_subtype_details" not in text
    assert "PushedFilters: [IsNotNull(schema_name)" in text


def test_counts_are_taken_before_the_shuffle(stored):
    text = plan(diff.versions(*stored, list(CHILD_KEYS)))
    assert text.count("Exchange hashpartitioning") == 1
    assert "partial_sum" in text[text.index("Exchange hashpartitioning") :]


def test_full_rows_do_not_move_for_a_small_change(spark, stored):
    """With the located keys written, their size is known and the full rows stay where they are."""
    root = spark.conf.get("spark.checkpoint.dir")

    def settle(name, df):
        df.write.mode("overwrite").parquet(f"{root}/plans/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/plans/{name}")

    located = settle("located", diff.locate(*stored, list(CHILD_KEYS), collision_safe=False, settle=settle))
    changes = diff.attach(located, *stored, list(CHILD_KEYS))
    text = plan(changes)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text
    assert changes.count() == 40


def test_no_cross_join_anywhere(stored):
    for df in (diff.diff_child(*stored), diff.diff_entity(*stored)):
        assert not re.search("Cartesian|NestedLoop", plan(df))


def test_children_move_once(stored):
    """All counts of a child's changes come from one exchange, that of the rows by their parent."""
    text = plan(diff.diff_child(*stored))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_hot_key_is_split_by_the_skew_join(spark):
    """A third of the versions share one key; its join partition is read by several tasks."""
    columns = [f"CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END as {c}" for c in CHILD_KEYS]

    def side(shift):
        return spark.range(0, 200_000, 1, 12).selectExpr(
            *columns, "'' as object_subtype_details", f"md5(cast(id + {shift} as string)) as object_md5"
        )

    settings = {
        "spark.sql.shuffle.partitions": "16",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200KB",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = diff.locate(side(1), side(0), list(CHILD_KEYS), collision_safe=False).groupBy("change_type").agg(
            F.sum("copies").alias("n")
        )
        counts = {r.change_type: r.n for r in found.collect()}
        assert "skew=true" in plan(found)
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # Each of 66,667 hot rows differs from all previous ones, each other key from its own.
    assert counts == {"MODIFIED": 66_667 * 66_667 + 133_333}


def test_report_of_one_snapshot_reads_one_folder(spark, tmp_path):
    child(spark, [("s", "t", "Column", "c", "m")]).withColumn("snapshot_id", F.explode(F.array(F.lit(1), F.lit(2)))).write.partitionBy(
        "snapshot_id"
    ).parquet(str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    newest = reports.report_changes_of(log)
    assert {r.snapshot_id for r in newest.collect()} == {2}
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan(newest)


def test_metrics_read_the_log_once(spark, tmp_path):
    from driftmark.operators.metrics import metrics_run

    columns = "schema_name string, object_type string, object_type_name string, object_subtype string, change_type string, copies bigint"
    spark.createDataFrame([("s", "Table", "t", "Column", "ADDED", 2)], columns).write.parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    found = metrics_run(log, spark.createDataFrame([("s",), ("r",)], "schema_name string"))
    assert len(re.findall("FileScan parquet", plan(found))) == 1
    assert {r.metric_name: r.metric_value for r in found.collect()} == {
        "Schemas Monitored": 2, "Schemas With Changes": 1, "Total Change Operations": 2, "Tables With Changes": 1, "Tables Added": 1,
        "Tables Modified": 0, "Tables Dropped": 0, "Tables Renamed": 0, "Columns Added": 2,
    }


def test_window_reads_the_snapshots_it_is_about(spark, tmp_path):
    """The registry's rows of the window become a filter on the log's folders while the job runs."""
    from datetime import datetime, timedelta

    from driftmark.sources.store import CHANGES, REGISTRY, SnapshotStore

    store, first = SnapshotStore(spark, str(tmp_path)), datetime(2024, 1, 1)
    days = [(n, f"snapshot_{n}", first + timedelta(days=n)) for n in range(1, 21)]
    registry = spark.createDataFrame(days, store.schemas[REGISTRY])
    store.write_snapshots(REGISTRY, registry)
    log = spark.range(2000).selectExpr(
        "cast(id % 20 + 1 as int) as snapshot_id", "'s' as schema_name", "'Table' as object_type", "'t' as object_type_name",
        "'Column' as object_subtype", "cast(id as string) as object_subtype_name", "'d' as object_subtype_details",
        "md5(cast(id as string)) as object_md5", "'ADDED' as change_type", "1L as copies",
    ).join(registry.drop("snapshot_name"), "snapshot_id")
    store.write_snapshots(CHANGES, log)
    found = store.window(first + timedelta(days=3), first + timedelta(days=5))
    assert re.search(r"dynamicpruning.*snapshot_id", plan(found))
    assert {r.snapshot_id for r in found.collect()} == {3, 4, 5} and found.count() == 300
    with_times = reports.report_window(store.read(CHANGES), first + timedelta(days=3), first + timedelta(days=5))
    assert with_times.count() == 300
    # Written again, a part of the snapshots replaces itself and leaves the others.
    store.write_snapshots(CHANGES, log.where("snapshot_id = 4 AND cast(object_subtype_name as int) < 1000"))
    assert store.window(first + timedelta(days=3), first + timedelta(days=5)).count() == 250


def test_derived_columns_are_dealt_by_neither_type_nor_sort(spark):
    """Types have a size that Spark knows, so columns don't meet in one task per type; a column's flag is found
    without sorting the lines."""
    x = extracts(spark, "/root/testdata/sf0.001")
    plan = fingerprints.fp_columns(x)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [atttypid" not in plan and "BroadcastHashJoin [atttypid" in plan
    assert "SortAggregate" not in x["attribute"]._jdf.queryExecution().executedPlan().toString()


def test_both_states_of_a_baseline_in_one_pass(spark):
    rows = fingerprints.union_current(extracts(spark, "/root/testdata/sf0.001", "previous"))
    both = [df.withColumn("level", F.lit(level)) for level, df in zip(("child", "entity"), routing.route_state(rows))]
    want = both[0].unionByName(both[1])
    found = routing.staged(rows)
    assert Counter(found.collect()) == Counter(want.collect())

    def scans(df):
        return plan(df).count("FileScan parquet [l_")

    run = q_diff.queries()["route_state"][0](spark, "/root/testdata/sf0.001")
    assert scans(run) == scans(rows.drop("source_db"))
