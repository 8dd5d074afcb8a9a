"""Clustered states: what is read, what is exchanged, and that the changes are those of the whole states."""

from __future__ import annotations

import random
import re
from datetime import datetime, timedelta

import pytest
from driftmark.operators import diff
from driftmark.plans.clustered_diff import clustered_changes
from driftmark.plans.snapshot_run import CurrentState, run
from driftmark.schemas import CHILD_KEYS
from driftmark.sources.clustered import CLUSTER, co_partitioned
from driftmark.sources.store import CHANGES, STATE_CHILD, STATE_ENTITY, SnapshotStore
from pyspark.sql import functions as F

from tests.helpers import brute_child, brute_entity, child, entity, log_rows

AT = datetime(2024, 1, 1)


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"), buckets=4)


def stage(store, table, *states):
    for n, state in enumerate(states, 1):
        store.write_state(table, n, state, AT)
    return store.clustered[table]


def changes(store, states, current=2, previous=1, **options):
    settle, _ = store.settle_clustered("t")
    return clustered_changes(states, current, previous, settle=store.write_scratch, settle_clustered=settle, **options)


def random_child(rng, n):
    return [
        (rng.choice(["a", "b", None]), f"t{rng.randrange(8)}", rng.choice(["Column", "Index"]), f"c{rng.randrange(6)}", rng.choice(["m1", "m2", f"u{i}", None]))
        for i in range(n)
    ]


@pytest.mark.parametrize("hot_rows", [10**9, 3])
def test_child_changes_are_those_of_the_whole_states(spark, store, hot_rows):
    rng = random.Random(5)
    before = random_child(rng, 120)
    now = [r for r in before if rng.random() < 0.8] + random_child(rng, 20)
    cur, prev = child(spark, now), child(spark, before)
    states = stage(store, STATE_CHILD, prev, cur)
    assert log_rows(changes(store, states, hot_rows=hot_rows)) == brute_child(cur, prev)


@pytest.mark.parametrize("hot_rows", [10**9, 3])
def test_entity_changes_are_those_of_the_whole_states(spark, store, hot_rows):
    rng = random.Random(6)

    def some(n):
        return [(rng.choice("ab"), rng.choice(["View", "Function"]), f"n{rng.randrange(20)}", rng.choice(["m1", f"u{rng.randrange(30)}"])) for _ in range(n)]

    before = some(60)
    now = [r for r in before if rng.random() < 0.7] + some(15)
    cur, prev = entity(spark, now), entity(spark, before)
    states = stage(store, STATE_ENTITY, prev, cur)
    assert log_rows(changes(store, states, hot_rows=hot_rows)) == brute_entity(cur, prev)


def many(n, changed=()):
    return [("s", f"t{i // 5}", "Column", f"c{i}", f"m{i}" + ("x" if i in changed else "")) for i in range(n)]


def test_equal_states_are_not_read(spark, store):
    states = stage(store, STATE_CHILD, child(spark, many(400)), child(spark, many(400)))
    assert states.to_read(2, 1) == {}
    pair = states.pair(2, 1, [])
    assert pair._jdf.queryExecution().optimizedPlan().toString().startswith("LocalRelation <empty>")
    assert scanned_bytes(spark, lambda: pair.collect()) == 0 < scanned_bytes(spark, lambda: states.pair(2, 1).collect())
    assert changes(store, states).count() == 0


def scanned_bytes(spark, action):
    """Bytes that the tasks of an action have read from files."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).inputBytes() for i in range(stages.size()))

    before = total()
    action()
    return total() - before


def test_one_changed_parent_reads_its_bucket_only(spark, store):
    states = stage(store, STATE_CHILD, child(spark, many(400)), child(spark, many(400, changed={7})))
    clusters = states.to_read(2, 1)
    assert len(clusters) == 1
    some = states.pair(2, 1, list(clusters))
    files = {r.f for r in some.select(F.input_file_name().alias("f")).distinct().collect()}
    whole = {r.f for r in states.pair(2, 1).select(F.input_file_name().alias("f")).distinct().collect()}
    assert len(files) == 2 and len(whole) == 8
    assert [(r.change_type, r.object_subtype_name) for r in changes(store, states).collect()] == [("MODIFIED", "c7")]


def test_restless_clusters_are_always_read(spark, store):
    calm = many(100)
    for odd in ([("s", "two", "Column", "a", "m"), ("s", "two", "Column", "b", "m")], [("s", "dup", "Column", "a", "m"), ("s", "dup", "Column", "a", "n")], [("s", "nul", "Column", None, "m")]):
        rows = child(spark, calm + odd)
        states = stage(store, STATE_CHILD, rows, rows)
        assert len(states.to_read(2, 1)) == 1
        assert log_rows(changes(store, states)) == brute_child(rows, rows) != {}


def test_nothing_is_exchanged(spark, store):
    """Without broadcasts neither the details nor the keys leave their task."""
    states = stage(store, STATE_CHILD, child(spark, many(400)), child(spark, many(400, changed=set(range(0, 400, 9)))))
    keys = [CLUSTER, *CHILD_KEYS]
    settle, _ = store.settle_clustered("plan")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with co_partitioned(spark):
            both = states.pair(2, 1, sorted(states.to_read(2, 1)))
            located = settle("located", diff.locate_in(both, keys, collision_safe=False, settle=settle))
            plan = diff.attach_in(located, both, keys)._jdf.queryExecution().executedPlan().toString()
            versions = diff.versions_in(both, keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert not re.search(r"Exchange (hash|range|round|Single)", plan) and "Exchange" not in plan
    assert "Exchange" not in versions


def test_runs_with_and_without_clusters_log_the_same(spark, tmp_path):
    rng = random.Random(9)
    steps = [random_child(rng, 60)]
    for _ in range(1):
        steps.append([r for r in steps[-1] if rng.random() < 0.85] + random_child(rng, 8))
    steps.append(steps[-1])
    logs = []
    for name, buckets in (("plain", None), ("clustered", 3)):
        store = SnapshotStore(spark, str(tmp_path / name), buckets=buckets)
        for i, rows in enumerate(steps):
            state = CurrentState.of_rows(child(spark, rows), entity(spark, [("s", "View", f"v{j}", f"{i}{j}") for j in range(i, 6)]))
            run(store, state, now=AT + timedelta(days=i))
        logs.append([log_rows(store.read_snapshot(CHANGES, n)) for n in range(1, len(steps) + 1)])
    assert logs[0] == logs[1]


def test_a_plain_store_can_become_clustered(spark, tmp_path):
    """States staged without buckets, or with others, are compared by the general plan."""
    root, expected = str(tmp_path / "store"), brute_child(child(spark, many(30, {2})), child(spark, many(30)))
    run(SnapshotStore(spark, root), CurrentState.of_rows(child(spark, many(30)), entity(spark, [])), now=AT)
    for n, buckets in ((2, 2), (3, 5), (4, 5)):
        rows = many(30, {2}) if n % 2 == 0 else many(30)
        store = SnapshotStore(spark, root, buckets=buckets)
        run(store, CurrentState.of_rows(child(spark, rows), entity(spark, [])), now=AT + timedelta(days=n))
        assert sum(log_rows(store.read_snapshot(CHANGES, n)).values()) == 1
        if n == 2:
            assert log_rows(store.read_snapshot(CHANGES, n)) == expected


def test_rollback_and_retention_drop_the_digests(spark, store):
    for n in range(3):
        run(store, CurrentState.of_rows(child(spark, many(20, {n})), entity(spark, [])), now=AT + timedelta(days=n))
    assert store.partitions(f"digest_{STATE_CHILD}") == store.partitions(STATE_CHILD) == [3]
    store.rollback(3)
    assert store.partitions(f"digest_{STATE_CHILD}") == store.partitions(STATE_CHILD) == []


def test_hot_parent_is_written_by_several_tasks(spark, store):
    """A parent with a third of the rows doesn't go through one writer."""
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k) for k in conf}
    rows = spark.range(30_000).selectExpr(
        "'s' as schema_name", "'Table' as object_type", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END as object_type_name",
        "'Column' as object_subtype", "cast(id as string) as object_subtype_name", "repeat(md5(cast(id as string)), 4) as object_subtype_details",
        "md5(cast(id as string)) as object_md5",
    )
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        states = stage(store, STATE_CHILD, rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    hot = states.read(1).where("object_type_name = 'hot'").select(F.input_file_name().alias("f")).distinct()
    assert hot.count() > 1
    assert states.read(1).count() == 30_000


def test_buckets_grow_with_the_states(spark, monkeypatch):
    """A task's share of a comparison doesn't grow with the tables; the result is the general one."""
    from driftmark.sources import clustered
    from workload import q_diff

    assert [clustered.buckets_for(n) for n in (0, 2_400_000, 2_400_001, 216_000_000)] == [16, 16, 17, 1440]
    made, store = [], q_diff.SnapshotStore
    monkeypatch.setattr(clustered, "ROWS_PER_BUCKET", 300)
    monkeypatch.setattr(q_diff, "SnapshotStore", lambda *args, **kw: made.append(kw.get("buckets")) or store(*args, **kw))
    sf, queries = "/root/testdata/sf0.001", q_diff.queries()
    found = queries["diff_child_clustered"][0](spark, sf)
    general = queries["diff_child_duplicates"][0](spark, sf).select(*found.columns)
    assert made[0] == -(-spark.read.parquet(f"{sf}/lineitem.parquet").count() // 300) > 16
    assert found.count() and found.exceptAll(general).isEmpty() and general.exceptAll(found).isEmpty()
