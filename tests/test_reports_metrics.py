from __future__ import annotations

import re
from datetime import datetime

import pytest

from driftmark.operators import reports
from driftmark.operators.metrics import metrics_object, metrics_run, metrics_table

LOG = (
    "snapshot_id int, schema_name string, object_type string, object_type_name string, object_subtype string, "
    "object_subtype_name string, object_subtype_details string, change_type string, processed_time timestamp_ntz"
)
AT = datetime(2024, 1, 1, 10, 0, 0, 129_999)


def log(spark, rows):
    return reports.report_normalise(spark.createDataFrame([(*r, AT) for r in rows], LOG))


def metrics(df):
    return {r.metric_name: r.metric_value for r in df.collect()}


def test_metrics_of_an_empty_log_are_the_base_ones(spark):
    empty = spark.createDataFrame([], LOG).drop("snapshot_id")
    staged = spark.createDataFrame([("a",), ("b",), ("a",)], "schema_name string")
    assert metrics(metrics_run(empty, staged)) == {
        "Schemas Monitored": 2,
        "Schemas With Changes": 0,
        "Total Change Operations": 0,
    }


def test_table_metrics_are_zero_when_only_other_objects_changed(spark):
    rows = spark.createDataFrame([(1, "s", "Function", "f()", None, None, "", "ADDED", AT)], LOG)
    assert set(metrics(metrics_table(rows)).values()) == {0}
    assert len(metrics(metrics_table(rows))) == 5


def test_table_metric_ignores_the_schema(spark):
    rows = [(1, s, "Table", "t", "Column", "c", "", "ADDED", AT) for s in ("a", "b")]
    found = metrics(metrics_table(spark.createDataFrame(rows, LOG)))
    assert found["Tables With Changes"] == found["Tables Added"] == 1


def test_object_metric_rule(spark):
    rows = [
        (1, "s", "Table", "t", "Sequence", "q", "", "ADDED", AT),
        (1, "s", "View", "v", "Sequence", "q", "", "ADDED", AT),  # counts by subtype alone
        (1, "s", "Sequence", "q", None, None, "", "ADDED", AT),
        (1, "s", "View", "v", "Column", "c", "", "ADDED", AT),  # not a view of its own
        (1, "s", "View", "v", None, None, "", "ADDED", AT),
    ]
    found = metrics(metrics_object(spark.createDataFrame(rows, LOG)))
    assert found == {"Table Sequences Added": 2, "Schema Sequences Added": 1, "Columns Added": 1, "Views Added": 1}


def test_latest_two_needs_two_snapshots(spark):
    rows = [(n, "s", "Table", "t", "Column", "c", "", "ADDED") for n in (3, 3, 7)]
    df = log(spark, rows)
    assert reports.require_two_snapshots(df) == {None: [7, 3]}
    assert sorted(r.snapshot_id for r in reports.report_latest_two(df).collect()) == [3, 7]
    with pytest.raises(ValueError, match="needs two snapshots"):
        reports.require_two_snapshots(df.where("snapshot_id = 3"))


def test_window_rules():
    now = datetime(2024, 5, 10, 9, 30)
    day = datetime(2024, 5, 1)
    assert reports.window_resolve() is None
    assert reports.window_resolve(day, now=now) == (day, now)
    assert reports.window_resolve(day, datetime(2024, 5, 2)) == (day, datetime(2024, 5, 2, 23, 59, 59))
    assert reports.window_resolve(preset="1M", now=now) == (datetime(2024, 4, 10, 9, 30), now)
    with pytest.raises(ValueError, match="begin before"):
        reports.window_resolve(now, day)


def test_time_is_cut_to_hundredths(spark):
    df = log(spark, [(1, "s", "Table", "t", "Trigger", "g", "", "ADDED")])
    assert reports.report_table_objects(df).first().processed_time == "2024-01-01 10:00:00.12"


def test_fully_deleted_table(spark):
    df = log(
        spark,
        [
            (1, "s", "Table", "t", None, None, None, "DELETED"),
            (1, "s", "Table", "t", "Trigger", "g", "", "ADDED"),
            (1, "s", "Table", "t", "Column", "c", "", "ADDED"),
            (1, "s", "Table", "u", "Trigger", "g", "", "ADDED"),
            (1, "s", "Table", "u", "Trigger", "g", "", "MODIFIED"),
        ],
    )
    summary = {r.object_type_name: r.change_types for r in reports.report_table_summary(df).collect()}
    assert summary == {"t": "DELETED", "u": "ADDED, MODIFIED"}
    assert [r.object_type_name for r in reports.report_table_objects(df).collect()] == ["u"]
    assert reports.report_column_impact(df).isEmpty()


def test_overloads_stay_apart_and_lose_their_arguments(spark):
    df = log(
        spark,
        [
            (1, "s", "Function", "f(int)", None, None, "", "ADDED"),
            (1, "s", "Function", "f(text)", None, None, "", "DELETED"),
        ],
    )
    found = sorted((r.object_name, r.change_types) for r in reports.report_schema_objects(df).collect())
    assert found == [("f", "ADDED"), ("f", "DELETED")]


NAMES = ["id", "ID2", "first name", "a-b", "a.b", "$x", "x$", "---", "", "ключ", "a b-c", "_id", "(id)"]
DETAILS = [
    "cols:id,k:1", "cols:ID,k", "cols:id2", "the First Name is", "firstname", "a-b", "a--b", "xa-b", "a.b", "aXb",
    "$x", "y$x", "y$x z", "x$y", "x$ y", "a---b", "a--- b", "", "  ", "поле ключ;", "ключи", "a b-c", "x _id y",
    "w(id)w", "(id)", "w(id) w",
]


def test_column_impact_equals_search_of_each_pair(spark):
    """Names of every kind against every text, as a case-insensitive whole-word search."""
    rows = [(n % 2, "s", "Table", "t", "Column", name, "", "MODIFIED") for n, name in enumerate(NAMES)]
    rows += [(1, "s", "Table", "t", "Index", f"ix{i}", d, "ADDED") for i, d in enumerate(DETAILS)]
    rows += [(1, "s", "Table", "other", "Index", "far", "id", "ADDED")]
    impact = reports.report_column_impact(log(spark, rows))
    found = {}
    for r in impact.collect():
        found.setdefault(r.column_name, []).extend([r.dependent] * r.links)
    counts = {r.column_name: r.dependent_count for r in reports.report_impacted_only(impact).collect()}
    for name in NAMES:
        word = re.compile(rf"\b{re.escape(name)}\b", re.IGNORECASE)
        expected = sorted(f"INDEX: ix{i} (ADDED)" for i, d in enumerate(DETAILS) if word.search(d))
        assert sorted(found[name]) == expected and counts.get(name, 0) == len(expected), name


def test_column_impact_has_one_shape_at_every_size(spark):
    rows = [(1, "s", "Table", "t", "Column", "c", "", "MODIFIED"), (1, "s", "Table", "u", "Column", "d", "", "ADDED")]
    rows += [(1, "s", "Table", "u", "Index", "iy", "on d", "ADDED")] * 3
    rows += [(1, "s", "Table", "t", "Index", f"ix{i:05}", "on c", "ADDED") for i in range(12_000)]
    impact = reports.report_column_impact(log(spark, rows))
    found = {(r.column_name, r.dependent): r.links for r in impact.collect()}
    assert found == {("d", "INDEX: iy (ADDED)"): 3, **{("c", f"INDEX: ix{i:05} (ADDED)"): 1 for i in range(12_000)}}
    counts = {r.column_name: r.dependent_count for r in reports.report_impacted_only(impact).collect()}
    assert counts == {"c": 12_000, "d": 3}
    shown = {r.column_name: (r.dependent_count, r.dependent_preview) for r in reports.report_preview(impact).collect()}
    lists = {"c": "; ".join(f"INDEX: ix{i:05} (ADDED)" for i in range(12_000)), "d": "; ".join(["INDEX: iy (ADDED)"] * 3)}
    assert shown == {"c": (12_000, lists["c"][:90] + "..."), "d": (3, lists["d"])}


def test_preview_of_one_repeated_dependent_and_of_none(spark):
    rows = [(1, "s", "Table", "t", "Column", "c", "", "MODIFIED"), (1, "s", "Table", "t", "Column", "z", "", "ADDED")]
    rows += [(1, "s", "Table", "t", "Index", "ix", "on c", "ADDED")] * 1000
    impact = reports.report_column_impact(log(spark, rows))
    shown = {r.column_name: (r.dependent_count, r.dependent_preview) for r in reports.report_preview(impact).collect()}
    assert shown == {"c": (1000, "; ".join(["INDEX: ix (ADDED)"] * 1000)[:90] + "..."), "z": (0, "")}
    assert [r.column_name for r in reports.report_impacted_only(impact).collect()] == ["c"]


def test_preview_picks_its_dependents_before_the_shuffle(spark):
    impact = reports.report_column_impact(log(spark, [(1, "s", "Table", "t", "Column", "c", "", "MODIFIED")]))
    text = reports.report_preview(impact)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in text and "Cartesian" not in text


def test_each_database_has_its_own_newest_snapshot(spark):
    rows = [(db, n, "s", "Table", f"t{n}", None, None, None, "ADDED", AT) for db, n in (("a", 1), ("b", 1), ("b", 2))]
    df = spark.createDataFrame(rows, "source_db string, " + LOG)
    assert sorted((r.source_db, r.snapshot_id) for r in reports.report_changes_of(df).collect()) == [("a", 1), ("b", 2)]
    with pytest.raises(ValueError, match="two snapshots in a"):
        reports.require_two_snapshots(df)
    with pytest.raises(ValueError, match="two snapshots in a"):
        reports.report_log(df)
    assert reports.require_two_snapshots(df.where("source_db = 'b'")) == {"b": [2, 1]}
    assert reports.report_log(df.where("source_db = 'b'"), schemas=["s"]).count() == 1
    assert reports.report_log(df, (AT, AT), change_types=["DELETED"]).count() == 0


def test_dependents_come_from_the_whole_window(spark):
    rows = [
        (1, "s", "Table", "t", "Column", "c", "", "MODIFIED"),
        (2, "s", "Table", "t", "Constraint", "k", "on C", "DELETED"),
    ]
    (row,) = reports.report_column_impact(log(spark, rows)).collect()
    assert (row.snapshot_id, row.dependent, row.links) == (1, "CONSTRAINT: k (DELETED)", 1)
    assert reports.report_preview(reports.report_column_impact(log(spark, rows)), 5).first().dependent_preview == (
        "CONST..."
    )
