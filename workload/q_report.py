"""Queries of the change reports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.functions.canon import fmt_time
from driftmark.operators import reports
from driftmark.operators.joins import skew_join
from driftmark.sources.store import CHANGES, REGISTRY, SnapshotStore, shared_folder
from workload.catalog_sql import statement
from workload.log import event_log, event_log_sql

Query = tuple[Callable[[SparkSession, str], DataFrame], str | None]

START, END = datetime(2024, 1, 5, 12), datetime(2024, 1, 9)

_TIME = "strftime({t}, '%Y-%m-%d %H:%M:%S.') || substr(strftime({t}, '%f'), 1, 2)"
_CHANGES = "string_agg(DISTINCT change_type, ', ' ORDER BY change_type) AS change_types"
_TABLE = "snapshot_id, schema_name, object_type_name"
NAMED = {
    "log": event_log_sql(),
    "n": """SELECT * REPLACE (upper(object_type) AS object_type, upper(coalesce(object_subtype, '')) AS object_subtype,
                   upper(change_type) AS change_type, coalesce(object_subtype_details, '') AS object_subtype_details)
            FROM log""",
    "gone": f"""SELECT DISTINCT {_TABLE} FROM n
            WHERE object_type = 'TABLE' AND object_subtype = '' AND change_type = 'DELETED'""",
    "deps": """SELECT schema_name, object_type_name, object_subtype_details,
                   object_subtype || ': ' || object_subtype_name || ' (' || change_type || ')' AS dependent
            FROM n WHERE object_subtype IN ('INDEX', 'CONSTRAINT', 'SEQUENCE', 'REFERENCE', 'TRIGGER')""",
    "cols": f"""SELECT snapshot_id, schema_name, object_type_name, object_subtype_name AS column_name,
                   min(object_type) AS object_type, {_TIME.format(t="min(processed_time)")} AS processed_time, {_CHANGES}
            FROM n c WHERE object_subtype = 'COLUMN' AND NOT EXISTS (
                SELECT 1 FROM gone g WHERE g.snapshot_id = c.snapshot_id AND g.schema_name = c.schema_name
                   AND g.object_type_name = c.object_type_name AND c.object_type = 'TABLE')
            GROUP BY snapshot_id, schema_name, object_type_name, object_subtype_name""",
    "met": """SELECT c.*, d.dependent
            FROM cols c LEFT JOIN deps d ON d.schema_name = c.schema_name AND d.object_type_name = c.object_type_name
                 AND regexp_matches(d.object_subtype_details, '(?i)\\b' || regexp_escape(c.column_name) || '\\b')""",
    "impact": "SELECT *, count(dependent) AS links FROM met GROUP BY ALL",
}


def _on(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The operator over the normalised log."""
    return lambda spark, sf: operator(reports.report_normalise(event_log(spark, sf)))


def _texts(df: DataFrame) -> DataFrame:
    return df.withColumn("processed_time", fmt_time("processed_time"))


_LOG_TEXT = f"SELECT * REPLACE ({_TIME.format(t='processed_time')} AS processed_time) FROM"


def _db_log(spark: SparkSession, sf: str) -> DataFrame:
    """The log of three databases, one of which had no changes in the second half of the days."""
    log = event_log(spark, sf).withColumn("source_db", F.expr("concat('db_', cast(substr(schema_name, 8) as int) % 3)"))
    return log.where("source_db <> 'db_1' OR snapshot_id <= 15")


_DB_LOG = """SELECT * FROM (SELECT *, 'db_' || (substr(schema_name, 8)::INT % 3) AS source_db FROM log)
            WHERE source_db <> 'db_1' OR snapshot_id <= 15"""


def _window_pruned(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the snapshots in a window, from a stored log whose other folders aren't read."""
    store = SnapshotStore(spark, shared_folder(spark))
    log = event_log(spark, sf).withColumn("copies", F.lit(1).cast("long"))
    days = log.groupBy("snapshot_id").agg(F.max("processed_time").alias("processed_time"))
    store.write_snapshots(REGISTRY, days.withColumn("snapshot_name", F.concat(F.lit("snapshot_"), "snapshot_id")))
    store.write_snapshots(CHANGES, skew_join(log.drop("processed_time"), days, ["snapshot_id"]))
    found = store.window(START, END).groupBy("snapshot_id")
    return found.agg(F.count("*").alias("n_rows"), F.count_distinct("object_md5").alias("n_md5s"))


def queries() -> dict[str, Query]:
    def sql(last: str) -> str:
        return statement(NAMED, last)

    def windowed(preset: str | None = None, **bounds) -> Callable[[SparkSession, str], DataFrame]:
        window = reports.window_resolve(preset=preset, **bounds)
        return lambda spark, sf: _texts(reports.report_window(event_log(spark, sf), *window))

    out: dict[str, Query] = {}
    out["report_latest_two"] = (
        lambda spark, sf: reports.report_latest_two(event_log(spark, sf)).withColumn(
            "snapshot_time", fmt_time("snapshot_time")
        ),
        sql(
            f"SELECT snapshot_id, {_TIME.format(t='min(processed_time)')} AS snapshot_time FROM log "
            "GROUP BY snapshot_id ORDER BY snapshot_id DESC LIMIT 2"
        ),
    )
    out["report_changes_of"] = (
        lambda spark, sf: _texts(reports.report_changes_of(event_log(spark, sf))),
        sql(f"{_LOG_TEXT} log WHERE snapshot_id = (SELECT max(snapshot_id) FROM log)"),
    )
    out["report_changes_of_multi_db"] = (
        lambda spark, sf: _texts(reports.report_changes_of(_db_log(spark, sf))),
        sql(
            f"{_LOG_TEXT} ({_DB_LOG}) l WHERE snapshot_id = "
            f"(SELECT max(snapshot_id) FROM ({_DB_LOG}) x WHERE x.source_db = l.source_db)"
        ),
    )
    out["report_latest_two_multi_db"] = (
        lambda spark, sf: reports.report_latest_two(_db_log(spark, sf)).withColumn(
            "snapshot_time", fmt_time("snapshot_time")
        ),
        sql(
            f"SELECT source_db, snapshot_id, {_TIME.format(t='min(processed_time)')} AS snapshot_time "
            f"FROM ({_DB_LOG}) GROUP BY source_db, snapshot_id "
            "QUALIFY row_number() OVER (PARTITION BY source_db ORDER BY snapshot_id DESC) <= 2"
        ),
    )
    out["report_log_multi_db"] = (
        lambda spark, sf: reports.report_table_summary(
            reports.report_log(_db_log(spark, sf), schemas=["schema_1", "schema_2", "schema_3"])
        ),
        statement(
            {
                "log": event_log_sql(),
                "every": _DB_LOG,
                "picked": "SELECT * FROM every e WHERE snapshot_id = (SELECT max(snapshot_id) FROM every x "
                "WHERE x.source_db = e.source_db) AND schema_name IN ('schema_1', 'schema_2', 'schema_3')",
                "n": NAMED["n"].replace("FROM log", "FROM picked"),
                "gone": NAMED["gone"].replace("DISTINCT", "DISTINCT source_db,"),
            },
            "SELECT source_db, t.snapshot_id, t.schema_name, t.object_type_name, t.processed_time, "
            "CASE WHEN g.snapshot_id IS NULL THEN t.change_types ELSE 'DELETED' END AS change_types, total_changes "
            f"FROM (SELECT source_db, {_TABLE}, {_TIME.format(t='min(processed_time)')} AS processed_time, {_CHANGES}, "
            f"count(*) AS total_changes FROM n WHERE object_type = 'TABLE' GROUP BY source_db, {_TABLE}) t "
            f"LEFT JOIN gone g USING (source_db, {_TABLE})",
        ),
    )
    out["report_window"] = (
        lambda spark, sf: _texts(reports.report_window(event_log(spark, sf), START, END)),
        sql(f"{_LOG_TEXT} log WHERE processed_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}'"),
    )
    out["report_window_pruned"] = (
        _window_pruned,
        sql(
            "SELECT l.snapshot_id, count(*) AS n_rows, count(DISTINCT l.object_md5) AS n_md5s FROM log l "
            "JOIN (SELECT snapshot_id, max(processed_time) AS t FROM log GROUP BY snapshot_id) r "
            f"ON r.snapshot_id = l.snapshot_id AND r.t BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '{END}' GROUP BY l.snapshot_id"
        ),
    )
    out["window_resolve"] = (
        windowed(start=START, end=END),
        sql(f"{_LOG_TEXT} log WHERE processed_time BETWEEN TIMESTAMP '{START}' AND TIMESTAMP '2024-01-09 23:59:59'"),
    )
    out["window_resolve_preset"] = (
        windowed("1W", now=datetime(2024, 1, 20, 8)),
        sql(
            f"{_LOG_TEXT} log WHERE processed_time BETWEEN TIMESTAMP '2024-01-13 08:00:00' "
            "AND TIMESTAMP '2024-01-20 08:00:00'"
        ),
    )
    out["report_normalise"] = (
        lambda spark, sf: _texts(reports.report_normalise(event_log(spark, sf))),
        sql(f"{_LOG_TEXT} (SELECT *, 1 AS copies FROM n)"),
    )
    out["report_filter"] = (
        _on(lambda log: _texts(reports.report_filter(log, ["schema_1", "schema_7"], ["ADDED", "DELETED"]))),
        sql(
            f"{_LOG_TEXT} (SELECT *, 1 AS copies FROM n) WHERE schema_name IN ('schema_1', 'schema_7') "
            "AND change_type IN ('ADDED', 'DELETED')"
        ),
    )
    out["report_schema_impact"] = (
        _on(reports.report_schema_impact),
        sql(
            f"SELECT snapshot_id, schema_name, {_TIME.format(t='min(processed_time)')} AS processed_time, {_CHANGES}, "
            "count(DISTINCT object_type_name) FILTER (object_type = 'TABLE') AS tables_affected, "
            "count(DISTINCT object_type_name) FILTER (object_type <> 'TABLE') AS schema_objects_affected, "
            "count(*) AS total_changes FROM n GROUP BY snapshot_id, schema_name"
        ),
    )
    out["report_table_summary"] = (
        _on(reports.report_table_summary),
        sql(
            f"SELECT t.snapshot_id, t.schema_name, t.object_type_name, t.processed_time, "
            "CASE WHEN g.snapshot_id IS NULL THEN t.change_types ELSE 'DELETED' END AS change_types, total_changes "
            f"FROM (SELECT {_TABLE}, {_TIME.format(t='min(processed_time)')} AS processed_time, {_CHANGES}, "
            f"count(*) AS total_changes FROM n WHERE object_type = 'TABLE' GROUP BY {_TABLE}) t "
            f"LEFT JOIN gone g USING ({_TABLE})"
        ),
    )
    out["report_column_impact"] = (_on(reports.report_column_impact), sql("SELECT * FROM impact"))
    out["report_impacted_only"] = (
        _on(lambda log: reports.report_impacted_only(reports.report_column_impact(log))),
        sql(
            "SELECT * EXCLUDE (dependent, links), sum(links) AS dependent_count FROM impact "
            "WHERE dependent IS NOT NULL GROUP BY ALL"
        ),
    )
    out["report_preview"] = (
        _on(lambda log: reports.report_preview(reports.report_column_impact(log))),
        sql(
            "SELECT * EXCLUDE (list), CASE WHEN length(list) <= 90 THEN list ELSE substr(list, 1, 90) || '...' END "
            "AS dependent_preview FROM (SELECT * EXCLUDE (dependent), count(dependent) AS dependent_count, "
            "coalesce(string_agg(dependent, '; ' ORDER BY dependent), '') AS list FROM met GROUP BY ALL)"
        ),
    )
    out["report_table_objects"] = (
        _on(reports.report_table_objects),
        sql(
            f"SELECT {_TABLE}, object_subtype, object_subtype_name, "
            f"{_TIME.format(t='min(processed_time)')} AS processed_time, {_CHANGES} FROM n "
            "WHERE object_type = 'TABLE' AND object_subtype IN ('TRIGGER', 'RULE', 'CHECK CONSTRAINT', "
            f"'TABLE CONSTRAINT', 'SEQUENCE') AND ({_TABLE}) NOT IN (SELECT ({_TABLE}) FROM gone) "
            f"GROUP BY {_TABLE}, object_subtype, object_subtype_name"
        ),
    )
    out["report_schema_objects"] = (
        _on(reports.report_schema_objects),
        sql(
            "SELECT snapshot_id, schema_name, object_type, split_part(object_type_name, '(', 1) AS object_name, "
            f"{_TIME.format(t='min(processed_time)')} AS processed_time, {_CHANGES}, count(*) AS total_changes "
            "FROM n WHERE object_type <> 'TABLE' GROUP BY snapshot_id, schema_name, object_type, object_type_name"
        ),
    )
    out["fmt_time"] = (
        lambda spark, sf: event_log(spark, sf).select("object_md5", fmt_time(F.col("processed_time")).alias("time_text")),
        sql(f"SELECT object_md5, {_TIME.format(t='processed_time')} AS time_text FROM log"),
    )
    return out
