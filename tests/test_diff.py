from __future__ import annotations

import random

import pytest
from helpers import brute_child, brute_entity, child, entity, log_rows

from driftmark.operators import diff


def types(df):
    return sorted((r.change_type, r.object_subtype_name or r.object_type_name, r.copies) for r in df.collect())


def test_child_rename_also_reports_the_old_name_deleted(spark):
    prev = child(spark, [("s", "t", "Column", "a", "m1"), ("s", "t", "Column", "b", "m2")])
    cur = child(spark, [("s", "t", "Column", "a2", "m1"), ("s", "t", "Column", "b", "m2")])
    assert types(diff.diff_child(cur, prev)) == [("DELETED", "a", 1), ("RENAMED", "a2", 1)]


def test_child_collision_safe_rename_reports_it_once(spark):
    prev = child(spark, [("s", "t", "Column", "a", "m1")])
    cur = child(spark, [("s", "t", "Column", "a2", "m1")])
    assert types(diff.diff_child(cur, prev, collision_safe=True)) == [("RENAMED", "a2", 1)]


def test_name_in_hash_makes_a_rename_added_and_deleted(spark):
    prev = child(spark, [("s", "t", "Index", "a", "m1")])
    cur = child(spark, [("s", "t", "Index", "b", "m2")])
    assert types(diff.diff_child(cur, prev)) == [("ADDED", "b", 1), ("DELETED", "a", 1)]


def test_table_rename_moves_all_children(spark):
    prev = child(spark, [("s", "t", "Column", "a", "m1")])
    cur = child(spark, [("s", "t2", "Column", "a", "m1")])
    assert types(diff.diff_child(cur, prev)) == [("ADDED", "a", 1), ("DELETED", "a", 1)]


def test_entity_swap_is_renamed_and_modified(spark):
    prev = entity(spark, [("s", "View", "A", "x"), ("s", "View", "B", "y")])
    cur = entity(spark, [("s", "View", "A", "y"), ("s", "View", "B", "x")])
    assert types(diff.diff_entity(cur, prev)) == [
        ("MODIFIED", "A", 1),
        ("MODIFIED", "B", 1),
        ("RENAMED", "A", 1),
        ("RENAMED", "B", 1),
    ]


def test_entity_rename_hides_the_old_name_and_keeps_it_as_previous(spark):
    prev = entity(spark, [("s", "View", "A", "x")])
    cur = entity(spark, [("s", "View", "B", "x")])
    (row,) = diff.diff_entity(cur, prev).collect()
    assert (row.change_type, row.object_type_name, row.prev_object_type_name) == ("RENAMED", "B", "A")
    processed = diff.entity_processed(diff.diff_entity(cur, prev)).collect()
    assert sorted(r.object_type_name for r in processed) == ["A", "B"]


def test_entity_copy_is_added(spark):
    prev = entity(spark, [("s", "View", "A", "x")])
    cur = entity(spark, [("s", "View", "A", "x"), ("s", "View", "B", "x")])
    assert types(diff.diff_entity(cur, prev)) == [("ADDED", "B", 1)]


def test_entity_modification_is_skipped_for_a_repeated_name(spark):
    prev = entity(spark, [("s", "View", "A", "x"), ("s", "View", "A", "c1")])
    cur = entity(spark, [("s", "View", "A", "y")])
    assert types(diff.diff_entity(cur, prev)) == []


def test_null_keys_match_nothing(spark):
    rows = [("s", "t", None, "a", "m1")]
    found = diff.diff_child(child(spark, rows), child(spark, rows))
    assert types(found) == [("ADDED", "a", 1), ("DELETED", "a", 1)]


def test_a_missing_md5_is_neither_equal_nor_unequal(spark):
    none, one = child(spark, [("s", "t", "Column", "a", None)]), child(spark, [("s", "t", "Column", "a", "m1")])
    empty = child(spark, [])
    assert types(diff.diff_child(none, empty)) == [("ADDED", "a", 1)]
    assert types(diff.diff_child(empty, none)) == [("DELETED", "a", 1)]
    for cur, prev in ((none, none), (none, one), (one, none)):
        assert types(diff.diff_child(cur, prev)) == []
        assert types(diff.diff_child(cur, prev, unchanged=True)) == []
    views = [entity(spark, [("s", "View", "A", m)]) for m in (None, "x")]
    assert types(diff.diff_entity(views[0], entity(spark, []))) == [("ADDED", "A", 1)]
    assert types(diff.diff_entity(views[0], views[1])) == types(diff.diff_entity(views[1], views[0])) == []


def test_same_state_has_no_changes_and_empty_start_is_all_added(spark):
    rows = [("s", f"t{i % 3}", "Column", f"c{i}", f"m{i}") for i in range(30)]
    state, none = child(spark, rows), child(spark, [])
    assert diff.diff_child(state, state).isEmpty()
    assert {r.change_type for r in diff.diff_child(state, none).collect()} == {"ADDED"}
    assert {r.change_type for r in diff.diff_child(none, state).collect()} == {"DELETED"}
    assert diff.diff_child(state, none).count() == diff.diff_child(none, state).count() == 30


def test_unchanged_is_reported_on_request(spark):
    prev = child(spark, [("s", "t", "Column", "a", "m1"), ("s", "t", "Column", "b", "m2")])
    cur = child(spark, [("s", "t", "Column", "a", "m1"), ("s", "t", "Column", "b", "m3")])
    assert types(diff.diff_child(cur, prev, unchanged=True)) == [("MODIFIED", "b", 1), ("UNCHANGED", "a", 1)]


@pytest.mark.parametrize("seed", range(4))
def test_child_counts_equal_all_pairs(spark, seed):
    """Few names and MD5s, so keys and MD5s repeat within and across the sides; some are NULL."""
    rng = random.Random(seed)

    def state():
        rows = {
            (
                rng.choice("st"),
                rng.choice(["t1", "t2"]),
                rng.choice(["Column", "Index", None]),
                rng.choice(["a", "b", "c", "d", None]),
                rng.choice(["m1", "m2", "m3", "m4", None]),
            )
            for _ in range(40)
        }
        return child(spark, sorted(rows, key=repr))

    cur, prev = state(), state()
    assert log_rows(diff.diff_child(cur, prev)) == brute_child(cur, prev)


@pytest.mark.parametrize("seed", range(4))
def test_entity_counts_equal_all_pairs(spark, seed):
    rng = random.Random(seed)

    def state():
        rows = {
            (rng.choice("s"), rng.choice(["View", "Function"]), f"n{rng.randrange(12)}", rng.choice([None, *(f"m{i}" for i in range(16))]))
            for _ in range(14)
        }
        return entity(spark, sorted(rows, key=repr))

    cur, prev = state(), state()
    assert log_rows(diff.diff_entity(cur, prev)) == brute_entity(cur, prev)


def test_hot_key_is_counted_not_paired(spark):
    """One key with 20,000 versions a side has 4 * 10^8 pairs; the rows stay 40,000."""
    columns = ["schema_name", "object_type", "object_type_name", "object_subtype", "object_subtype_name"]

    def side(start):
        return spark.range(start, start + 20_000).selectExpr(
            *[f"'k' as {c}" for c in columns],
            "concat('v', id) as object_subtype_details",
            "md5(cast(id as string)) as object_md5",
        )

    found = diff.diff_child(side(0), side(10_000))
    rows = found.groupBy("change_type").agg({"copies": "sum", "*": "count"}).collect()
    # 10,000 shared versions differ from 19,999 previous rows, 10,000 new ones from all 20,000.
    assert [(r.change_type, r["sum(copies)"], r["count(1)"]) for r in rows] == [
        ("MODIFIED", 10_000 * 19_999 + 10_000 * 20_000, 20_000)
    ]


def test_expand_copies_repeats_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 3), ("c", 70_000)], "k string, copies long")
    counts = {r.k: r["count"] for r in diff.expand_copies(rows).groupBy("k").count().collect()}
    assert counts == {"a": 1, "b": 3, "c": 70_000}


def test_databases_are_compared_apart(spark):
    def state(rows):
        df = child(spark, [r[1:] for r in rows])
        dbs = spark.createDataFrame([(r[0], r[4], r[5]) for r in rows], "source_db string, n string, m string")
        return df.join(dbs, (df.object_subtype_name == dbs.n) & (df.object_md5 == dbs.m)).drop("n", "m")

    prev = state([("d1", "s", "t", "Column", "a", "m1"), ("d2", "s", "t", "Column", "b", "m1")])
    cur = state([("d1", "s", "t", "Column", "a", "m1"), ("d2", "s", "t", "Column", "c", "m1")])
    found = sorted((r.source_db, r.change_type, r.object_subtype_name) for r in diff.diff_child(cur, prev).collect())
    assert found == [("d2", "DELETED", "b"), ("d2", "RENAMED", "c")]


@pytest.mark.parametrize("large_rows", [10**9, 3])
@pytest.mark.parametrize("unchanged", [False, True])
def test_parents_apart_give_the_same_changes(spark, large_rows, unchanged):
    """Repeated keys, shared and missing MD5s, null keys: windows, and windows beside large parents."""
    rng = random.Random(8)

    def some(n):
        return [
            (rng.choice(["a", "b", None]), f"t{rng.randrange(6)}", rng.choice(["Column", "Index"]), f"c{rng.randrange(5)}", rng.choice(["m1", "m2", f"u{i}", None]))
            for i in range(n)
        ]

    before = some(150)
    cur, prev = child(spark, [r for r in before if rng.random() < 0.8] + some(30)), child(spark, before)
    keys = list(diff.CHILD_KEYS)
    both = diff.sides(cur, prev, diff.row_columns(cur))
    assert bool(diff.large_parents(both, keys, large_rows)) == (large_rows == 3)
    found = diff.changes_in(both, keys, unchanged=unchanged, large_rows=large_rows)
    general = diff.attach(diff.locate(cur, prev, keys, collision_safe=False, unchanged=unchanged), cur, prev, keys)
    assert found.columns == general.columns
    assert sorted(map(str, found.collect())) == sorted(map(str, general.collect()))
    assert log_rows(found.where("change_type <> 'UNCHANGED'")) == brute_child(cur, prev)
