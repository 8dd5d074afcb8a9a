"""States rebuilt from the log are those that were once staged."""

from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from driftmark.plans.snapshot_run import CurrentState, run
from driftmark.sources.store import STATE_CHILD, STATE_ENTITY, STATES, SnapshotStore

from tests.helpers import child, entity

DAY = datetime(2024, 1, 1)


def rows_of(df):
    return Counter((r.schema_name, r.object_type, r.object_type_name, r.object_subtype, r.object_subtype_name, r.object_md5) for r in df.collect())


def take(store, spark, n, children, entities):
    run(store, CurrentState.of_rows(child(spark, children), entity(spark, entities)), now=DAY + timedelta(days=n))


def test_random_histories(spark, tmp_path):
    """Keys are unique; MD5s are shared, so that names are swapped, copied and taken over."""
    rng = random.Random(3)
    store = SnapshotStore(spark, str(tmp_path / "store"))
    children, entities, once = {}, {}, {}
    for n in range(1, 5):
        for state, keys in (
            (children, [("s", t, "Column", f"c{i}") for t in ("t", "u") for i in range(6)] + [("s", "t", "Column", None)]),
            (entities, [(s, "View", f"v{i}") for s in "ab" for i in range(6)]),
        ):
            for key in keys:
                chance = rng.random()
                if chance < 0.25:
                    state.pop(key, None)
                elif chance < 0.6:
                    state[key] = rng.choice(["m1", "m2", "m3", f"own{n}{key[-1]}"])
        take(store, spark, n, [(*k, m) for k, m in children.items()], [(*k, m) for k, m in entities.items()])
        once[n] = {t: rows_of(store.read_snapshot(t, n)) for t in STATES}
    for n in (2, 4):
        assert {t: rows_of(store.rebuilt_state(t, n)) for t in STATES} == once[n]
    store.rollback(4)
    store.restage(3)
    assert {t: rows_of(store.read_snapshot(t, 3)) for t in STATES} == once[3]


def test_a_chain_of_renames(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    for n, views in enumerate(([("s", "View", "a", "x")], [("s", "View", "b", "x")], [("s", "View", "c", "x"), ("s", "View", "a", "y")], [("s", "View", "d", "x")]), 1):
        take(store, spark, n, [], views)
        assert rows_of(store.rebuilt_state(STATE_ENTITY, n)) == rows_of(store.read_snapshot(STATE_ENTITY, n))


def test_what_the_log_does_not_tell_is_refused(spark, tmp_path):
    """A second row of a key is logged like a replacement."""
    store = SnapshotStore(spark, str(tmp_path / "store"))
    one, two = ("s", "t", "Column", "a", "m1"), ("s", "t", "Column", "a", "m2")
    for n, rows in enumerate(([one], [one, two], [one, two]), 1):
        take(store, spark, n, rows, [])
    store.rollback(3)
    with pytest.raises(RuntimeError, match="stage it again"):
        take(store, spark, 3, [one], [])
    assert store.partitions(STATE_CHILD) == [] and store.latest() == 2


def test_children_are_rebuilt_by_one_exchange(spark, tmp_path):
    """Rows of the log move once, to their key; keys with many rows take the general steps."""
    from driftmark.operators.replay import state_at
    from driftmark.schemas import CHILD_KEYS
    from driftmark.sources.store import CHANGES

    store = SnapshotStore(spark, str(tmp_path / "store"))
    names = [("s", "t", "Column", "a"), ("s", "t", "Column", "b"), ("s", "u", "Column", "a"), ("s", "u", "Column", None)]
    for n, md5s in enumerate((["m1", "m2", None, "m1"], ["m2", "m1", "m3", "m1"], ["m2", "m5", "m3", "m4"]), 1):
        take(store, spark, n, [(*k, m) for k, m in zip(names, md5s) if n != 2 or k != names[2]], [])
        log = store.read(CHANGES).where("object_subtype IS NOT NULL")
        found = state_at(log, CHILD_KEYS, n, collision_safe=False)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1, plan
        apart = state_at(log, CHILD_KEYS, n, collision_safe=False, large_rows=0)
        assert rows_of(found) == rows_of(apart) == rows_of(store.read_snapshot(STATE_CHILD, n))


def test_catalogs_of_several_snapshots_are_taken_once(spark, monkeypatch):
    from workload import q_diff

    taken = []
    monkeypatch.setattr(q_diff, "run", lambda store, state, now: taken.append(state) or len(taken))
    _, states = q_diff._catalog_history(spark, "/root/testdata/sf0.001")
    assert taken == [states["previous"], states["current"], states["previous"]]
    assert all(len(df.inputFiles()) for s in states.values() for df in (s.child, s.entity))
    assert all("_work" in f for s in states.values() for f in s.child.inputFiles())


def test_a_catalog_goes_when_it_was_taken_for_the_last_time(spark, monkeypatch):
    from pathlib import Path

    from workload import q_diff

    monkeypatch.setattr(q_diff, "run", lambda store, state, now: None)
    _, states = q_diff._catalog_history(spark, "/root/testdata/sf0.001")
    kept = {side: {Path(f.removeprefix("file://")).exists() for f in s.child.inputFiles()} for side, s in states.items()}
    assert kept == {"previous": {True}, "current": {False}}
