from __future__ import annotations

from datetime import datetime

import pytest
from helpers import child, entity
from pyspark.sql import functions as F

from driftmark.operators import lifecycle
from driftmark.plans.snapshot_run import CurrentState, route_state, run
from driftmark.sources.store import (
    CHANGES,
    METRICS,
    REGISTRY,
    RUN_REPORT,
    STATE_CHILD,
    STATE_DIGEST,
    STATE_ENTITY,
    SNAPSHOT_DATA,
    SnapshotStore,
    shared_folder,
)

DAY1, DAY2, DAY3 = (datetime(2024, 3, d, 4, 5, 6) for d in (1, 2, 3))


@pytest.fixture
def store(spark):
    return SnapshotStore(spark, shared_folder(spark))


def states(spark, step):
    """A table whose second column changes and a view that is renamed with each step."""
    return CurrentState.of_rows(
        child(spark, [("s", "t", "Column", "a", "m0"), ("s", "t", "Column", "b", f"m{step}")]),
        entity(spark, [("s", "View", f"v{step}", "x")]),
    )


def changes(store, n):
    rows = store.read_snapshot(CHANGES, n).collect()
    return sorted((r.change_type, r.object_type_name, r.object_subtype_name or "") for r in rows)


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_runs_advance_and_keep_one_state(spark, store):
    assert run(store, states(spark, 1), now=DAY1) == 1
    assert changes(store, 1) == [("ADDED", "t", "a"), ("ADDED", "t", "b"), ("ADDED", "v1", "")]
    assert run(store, states(spark, 2), now=DAY2) == 2
    assert changes(store, 2) == [("MODIFIED", "t", "b"), ("RENAMED", "v2", "")]
    assert store.partitions(STATE_CHILD) == store.partitions(STATE_ENTITY) == [2]
    assert store.latest_change_count() == 2
    registry = store.read(REGISTRY).orderBy("snapshot_id").collect()
    assert [(r.snapshot_id, r.snapshot_name) for r in registry] == [
        (1, "snapshot_1_2024_03_01_040506"),
        (2, "snapshot_2_2024_03_02_040506"),
    ]
    metrics = {r.metric_name: r.metric_value for r in store.read_snapshot(METRICS, 2).collect()}
    assert metrics["Schemas Monitored"] == metrics["Columns Modified"] == metrics["Views Renamed"] == 1
    assert metrics["Total Change Operations"] == 2 and metrics["Tables Added"] == 0
    steps = [r.step_name for r in store.read_snapshot(RUN_REPORT, 2).orderBy("step_no").collect()]
    assert steps[0] == "mode" and "compare_child" in steps


def test_run_without_changes_counts_only_base_metrics(spark, store):
    run(store, states(spark, 1), now=DAY1)
    run(store, states(spark, 1), now=DAY2)
    assert changes(store, 2) == [] and store.latest_change_count() == 0
    assert store.read_snapshot(METRICS, 2).count() == 3
    run(store, states(spark, 2), now=DAY3)
    assert len(changes(store, 3)) == 2


@pytest.mark.parametrize("failing", ["compare_entity", "metrics", "register"])
def test_failed_run_leaves_nothing_and_its_id_is_used_again(spark, store, failing):
    run(store, states(spark, 1), now=DAY1)

    def fail(step):
        if step == failing:
            raise RuntimeError("lock timeout")

    with pytest.raises(RuntimeError, match="lock timeout"):
        run(store, states(spark, 2), now=DAY2, on_step=fail)
    assert store.latest() == 1
    assert all(2 not in store.partitions(t) for t in (REGISTRY, *SNAPSHOT_DATA))
    assert store.partitions(STATE_CHILD) == [1], "the last state has to survive"
    assert run(store, states(spark, 2), now=DAY2) == 2
    assert changes(store, 2) == [("MODIFIED", "t", "b"), ("RENAMED", "v2", "")]


def test_rollback_removes_a_snapshot_everywhere(spark, store):
    for n in (1, 2, 3):
        run(store, states(spark, n), now=DAY1)
    store.rollback(3)
    assert store.latest() == 2 and store.previous(2) == 1
    assert all(3 not in store.partitions(t) for t in (REGISTRY, *SNAPSHOT_DATA))
    assert store.next_snapshot(DAY3) == (3, "snapshot_3_2024_03_03_040506")
    # The rolled back run had retired the state to compare with. It is rebuilt from the log, and a run
    # for which that can't be done is refused: nothing may be reported as new.
    kept = store.read_snapshot(STATE_DIGEST, 2).drop("snapshot_id")
    kept = spark.createDataFrame(kept.collect(), kept.schema)
    store.write_snapshot(STATE_DIGEST, 2, kept.withColumn("n_rows", F.col("n_rows") + 1))
    with pytest.raises(RuntimeError, match="stage it again"):
        run(store, states(spark, 3), now=DAY3)
    assert store.latest() == 2 and store.partitions(CHANGES) == [1, 2] and store.partitions(STATE_CHILD) == []
    store.write_snapshot(STATE_DIGEST, 2, kept)
    assert run(store, states(spark, 3), now=DAY3) == 3
    assert changes(store, 3) == [("MODIFIED", "t", "b"), ("RENAMED", "v3", "")]


def test_rows_of_databases_need_a_store_for_them(spark, store):
    rows = states(spark, 1).child.withColumn("source_db", F.lit("a"))
    with pytest.raises(ValueError, match="single database"):
        store.write_state(STATE_CHILD, 1, rows, DAY1)


def test_scope_of_a_run(spark):
    from test_catalog import ROWS

    from driftmark.plans.snapshot_run import resolve_scope
    from driftmark.schemas import EXTRACT_SCHEMAS
    from driftmark.sources.extracts import combine_databases

    names = ["app", "driftmark", "pg_catalog", "pg_toast", "information_schema", "other"]
    rows = {**ROWS, "schemata": [(n,) for n in names]}
    both = combine_databases({"a": {n: spark.createDataFrame(r, EXTRACT_SCHEMAS[n]) for n, r in rows.items()}})
    assert resolve_scope(both) == ["app", "other"]
    assert resolve_scope(both, ["other"]) == ["app"]
    assert resolve_scope(both, own="app") == ["driftmark", "other"]
    assert resolve_scope(both, ["app", "absent", "pg_catalog"], "include") == ["app", "pg_catalog"]
    assert resolve_scope(both, None) == resolve_scope(both, None, "include") == []
    with pytest.raises(ValueError, match="scope mode"):
        resolve_scope(both, [], "all")
    store = SnapshotStore(spark, shared_folder(spark), multi_db=True)
    with pytest.raises(ValueError, match="no schema"):
        run(store, both, schemas=["absent"], mode="include", now=DAY1)
    assert store.latest() is None
    run(store, both, schemas=["app", "absent"], mode="include", now=DAY1)
    assert {r.schema_name for r in store.read(CHANGES).collect()} == {"app"}


def test_once_daily(spark, store):
    assert run(store, states(spark, 1), now=DAY1, once_daily=True) == 1
    assert run(store, states(spark, 2), now=DAY1.replace(hour=20), once_daily=True) is None
    assert run(store, states(spark, 2), now=DAY2, once_daily=True) == 2


def test_orphans_are_refused_unless_allowed(spark, store):
    assert store.is_initial() and not store.has_orphans()
    store.write_state(STATE_CHILD, 5, states(spark, 1).child, DAY1)
    assert store.has_orphans()
    with pytest.raises(RuntimeError, match="not allowed"):
        run(store, states(spark, 1), now=DAY1)
    assert run(store, states(spark, 1), now=DAY1, allow_cleanup=True) == 1
    assert store.partitions(STATE_CHILD) == [1]


def test_writing_a_snapshot_again_replaces_it(spark, store):
    rows = states(spark, 1).child
    for _ in range(2):
        store.write_state(STATE_CHILD, 1, rows, DAY1)
    assert store.read(STATE_CHILD).count() == 2
    store.write_state(STATE_CHILD, 1, rows.limit(0), DAY1)
    assert store.read(STATE_CHILD).count() == 0


def test_metrics_upsert_updates_and_keeps(spark, store):
    def rows(**values):
        return spark.createDataFrame(list(values.items()), "metric_name string, metric_value long")

    store.upsert_metrics(1, rows(a=1, b=2), DAY1)
    store.upsert_metrics(1, rows(b=3, c=4), DAY2)
    found = {r.metric_name: (r.metric_value, r.metrics_time) for r in store.read_snapshot(METRICS, 1).collect()}
    assert found == {"a": (1, DAY1), "b": (3, DAY2), "c": (4, DAY2)}


def test_baseline_stages_view_columns_in_both_states(spark):
    rows = spark.createDataFrame(
        [
            ("s", "View", "v", "Column", "c", "", "m"),
            ("s", "View", "v", None, None, "", "m"),
            ("s", "Table", "t", "Sequence", "q", "", "m"),
            ("s", "Sequence", "q", None, None, "", "m"),
        ],
        child(spark, []).schema,
    )
    to_child, to_entity = route_state(rows)
    assert sorted((r.object_type, r.object_subtype) for r in to_child.collect()) == [
        ("Table", "Sequence"),
        ("View", "Column"),
    ]
    assert to_entity.count() == 3


def test_modified_view_with_columns_is_missed_after_a_baseline_only(spark, store):
    """The baseline holds the view's columns as entity rows, so its name isn't unique there."""

    def current(md5):
        columns = child(spark, [])
        view = entity(spark, [("s", "View", "v", md5)])
        column = spark.createDataFrame([("s", "View", "v", "Column", "c", "", "m")], columns.schema)
        return CurrentState(column, view, column.unionByName(view))

    run(store, current("x1"), now=DAY1)
    run(store, current("x2"), now=DAY2)
    assert changes(store, 2) == []
    run(store, current("x3"), now=DAY3)
    assert changes(store, 3) == [("MODIFIED", "v", "")]


def test_snapshot_filter_prunes_folders(spark, store):
    for n in (1, 2):
        store.write_state(STATE_CHILD, n, states(spark, n).child, DAY1)
        store.register(n, f"snapshot_{n}", DAY1)
    plan = store.read_snapshot(STATE_CHILD, 2)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(snapshot_id" in plan
    staged = store.staged_state(STATE_CHILD)
    assert {r.snapshot_id for r in staged.collect()} == {2}
    assert "PartitionFilters: [isnotnull(snapshot_id" in staged._jdf.queryExecution().toString()


def test_lifecycle_of_an_empty_registry(spark, store):
    registry = store.read(REGISTRY)
    assert lifecycle.is_initial(registry).first()[0]
    assert lifecycle.prev_snapshot(registry, 3).first()[0] is None
    assert not lifecycle.ran_on(registry, F.lit(DAY1.date())).first()[0]
    assert store.next_snapshot(DAY1)[0] == 1


def test_run_over_the_catalogs_of_two_databases(spark):
    """One run covers both; a change in one database is a change of that one only."""
    from test_catalog import ROWS

    from driftmark.schemas import EXTRACT_SCHEMAS
    from driftmark.sources.extracts import combine_databases

    def extract(**changed):
        return {n: spark.createDataFrame(changed.get(n, r), EXTRACT_SCHEMAS[n]) for n, r in ROWS.items()}

    renamed = [r if r[2] != "code" else (*r[:2], "code2", *r[3:]) for r in ROWS["attribute"]]
    store = SnapshotStore(spark, shared_folder(spark), multi_db=True)
    first = combine_databases({"a": extract(), "b": extract()})
    second = combine_databases({"a": extract(), "b": extract(attribute=renamed)})
    run(store, CurrentState.of_catalog(first), now=DAY1)
    run(store, CurrentState.of_catalog(second), now=DAY2)
    rows = store.read_snapshot(CHANGES, 2).collect()
    assert {r.source_db for r in rows} == {"b"}
    found = {(r.change_type, r.object_subtype, r.object_subtype_name) for r in rows}
    assert {("RENAMED", "Column", "code2"), ("DELETED", "Column", "code")} <= found
    totals = store.read_snapshot(METRICS, 2).where("metric_name = 'Total Change Operations'").collect()
    assert {r.source_db: r.metric_value > 0 for r in totals} == {"a": False, "b": True}


def test_a_run_compares_children_without_intermediate_results(spark, store, monkeypatch):
    """The rows of both states move once, to their parent; neither versions nor counts are written."""
    written, write = [], type(store).write_scratch
    monkeypatch.setattr(type(store), "write_scratch", lambda self, name, rows: written.append(name) or write(self, name, rows))
    for md5 in ("m1", "m2"):
        state = CurrentState.of_rows(child(spark, [("s", "t", "Column", "a", md5)]), entity(spark, []))
        run(store, state)
    assert [r.change_type for r in store.read_snapshot(CHANGES, 2).collect()] == ["MODIFIED"]
    assert not [n for n in written if "child" in n]


def test_rollback_query_takes_the_snapshot_again(spark):
    from workload.q_diff import queries

    found = queries()["rollback_snapshot"][0](spark, "/root/testdata/sf0.001")
    assert {r.snapshot_id for r in found.select("snapshot_id").distinct().collect()} == {1, 2}


def test_a_write_leaves_no_shuffle_files(spark, store):
    """Shuffle files go with the write that made them, so those of a run's steps don't add up."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_")}

    before, key = shuffled(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting = spark.conf.get(key)
    store.write_scratch("some", spark.range(1000).repartition(3, "id"))
    store.write_state(STATE_CHILD, 1, child(spark, [("s", "t", "Column", "a", "m")]).repartition(3, "object_md5"), DAY1)
    assert shuffled() <= before and spark.conf.get(key) == setting


def test_rows_of_a_catalog_are_made_distinct_without_shuffling_them(spark, store, monkeypatch):
    """Equal rows of a catalog are one object; where none repeats, only hashes are shuffled."""
    from test_catalog import ROWS

    from driftmark.schemas import DB, EXTRACT_SCHEMAS

    found = CurrentState.of_catalog({n: spark.createDataFrame(r, EXTRACT_SCHEMAS[n]).withColumn(DB, F.lit("a")) for n, r in ROWS.items()})
    for rows in (found.child, found.entity, found.everything):
        plan = rows._jdf.queryExecution().optimizedPlan()
        assert plan.nodeName() == "Union", plan.nodeName()
    twice = [("s", "t", "Column", "a", "m0"), ("s", "t", "Column", "a", "m0"), ("s", "t", "Column", "b", "m1")]
    views = [("s", "View", "v", "x"), ("s", "View", "v", "x")]
    state = CurrentState.of_rows(child(spark, twice), entity(spark, views))
    state.repeats = True
    for now in (DAY1, DAY2):
        run(store, state, now=now)
        assert store.staged_state(STATE_CHILD).count() == 2 and store.staged_state(STATE_ENTITY).count() == 1
    assert store.read_snapshot(CHANGES, 1).count() == 3 and not store.read_snapshot(CHANGES, 2).count()


def test_catalog_states_are_written_without_shuffling_whole_rows(spark, monkeypatch):
    """Both states are one union, without a distinct over it; hashes of the written rows find equal ones."""
    from workload import q_diff

    seen = []
    monkeypatch.setattr(q_diff, "distinct_as_written", lambda rows, write: seen.append(rows) or rows, raising=False)
    q_diff._written(spark, "/root/testdata/sf0.001", lambda s, sf, side: q_diff.union_child(q_diff.extracts(s, sf, side), distinct=False))
    plan = seen[0]._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "Union"


def test_a_baseline_writes_its_log_rows_once(spark, store, monkeypatch):
    """The rows that both states are staged from become the log's: there is no second copy of them."""
    tables, write = [], type(store).write_snapshot
    monkeypatch.setattr(type(store), "write_snapshot", lambda self, table, *rest: tables.append(table) or write(self, table, *rest))
    state = CurrentState.of_rows(child(spark, [("s", "t", "Column", "a", "m1")]), entity(spark, [("s", "View", "v", "x")]))
    run(store, state, now=DAY1)
    assert {STATE_CHILD, STATE_ENTITY} <= set(tables) and CHANGES not in tables
    log = store.read_snapshot(CHANGES, 1)
    assert sorted((r.object_subtype, r.change_type, r.copies) for r in log.fillna("", ["object_subtype"]).collect()) == [
        ("", "ADDED", 1), ("Column", "ADDED", 1),
    ]
    assert {r.processed_time for r in log.collect()} == {DAY1}
    run(store, state, now=DAY2)
    assert not store.read_snapshot(CHANGES, 2).count() and CHANGES in tables


def test_rows_are_stored_in_little_space(spark, store):
    import pyarrow.parquet as pq

    store.write_state(STATE_CHILD, 1, child(spark, [("s", "t", "Column", "a", "m1")]), DAY1)
    files = [*store.read_snapshot(STATE_CHILD, 1).inputFiles(), *store.write_scratch("some", spark.range(9)).inputFiles()]
    stored = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in files]
    codecs = [m.row_group(0).column(0).compression for m in stored if m.num_row_groups]
    assert len(codecs) > 1 and set(codecs) == {"ZSTD"}
