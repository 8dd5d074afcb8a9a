"""A change log derived from events: one snapshot per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from workload.states import table


def event_log(spark: SparkSession, sf: str) -> DataFrame:
    table_row, g = "event_id % 4 < 2", "floor(event_id / 4) % 8"
    named = {3: "ix_", 4: "ck_", 5: "tg_", 6: "sq_"}
    subtype = {3: "Index", 4: "Constraint", 5: "Trigger", 6: "Sequence"}
    subname_cases = " ".join(f"WHEN {i} THEN concat('{p}', event_id)" for i, p in named.items())
    subtype_cases = " ".join(f"WHEN {i} THEN '{s}'" for i, s in subtype.items())
    return table(spark, sf, "events").selectExpr(
        "dayofyear(ts) as snapshot_id",
        "concat('schema_', user_id % 10) as schema_name",
        "CASE event_id % 4 WHEN 2 THEN 'View' WHEN 3 THEN 'Function' ELSE 'Table' END as object_type",
        "concat('obj_', user_id, CASE WHEN event_id % 4 = 3 THEN '(a int)' ELSE '' END) as object_type_name",
        f"CASE WHEN {table_row} THEN CASE WHEN {g} <= 2 THEN 'Column' ELSE "
        f"CASE {g} {subtype_cases} END END END as object_subtype",
        f"CASE WHEN {table_row} THEN CASE WHEN {g} <= 2 THEN concat('col_', user_id % 5) ELSE "
        f"CASE {g} {subname_cases} END END END as object_subtype_name",
        "concat('columns:col_', event_id % 5, ',k:', event_id % 7) as object_subtype_details",
        "md5(cast(event_id as string)) as object_md5",
        "ts as processed_time",
        "CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'click' THEN 'MODIFIED' WHEN 'purchase' THEN 'RENAMED' "
        "WHEN 'error' THEN 'DELETED' ELSE 'UNCHANGED' END as change_type",
    )


def event_log_sql() -> str:
    return """
        SELECT dayofyear(ts) AS snapshot_id, 'schema_' || (user_id % 10) AS schema_name,
               CASE k WHEN 2 THEN 'View' WHEN 3 THEN 'Function' ELSE 'Table' END AS object_type,
               'obj_' || user_id || CASE WHEN k = 3 THEN '(a int)' ELSE '' END AS object_type_name,
               CASE WHEN k < 2 THEN CASE WHEN g < 3 THEN 'Column' WHEN g = 3 THEN 'Index' WHEN g = 4 THEN 'Constraint'
                    WHEN g = 5 THEN 'Trigger' WHEN g = 6 THEN 'Sequence' END END AS object_subtype,
               CASE WHEN k < 2 THEN CASE WHEN g < 3 THEN 'col_' || (user_id % 5) WHEN g = 3 THEN 'ix_' || event_id
                    WHEN g = 4 THEN 'ck_' || event_id WHEN g = 5 THEN 'tg_' || event_id
                    WHEN g = 6 THEN 'sq_' || event_id END END AS object_subtype_name,
               'columns:col_' || (event_id % 5) || ',k:' || (event_id % 7) AS object_subtype_details,
               md5(event_id::VARCHAR) AS object_md5, ts AS processed_time,
               CASE event_type WHEN 'signup' THEN 'ADDED' WHEN 'click' THEN 'MODIFIED' WHEN 'purchase' THEN 'RENAMED'
                    WHEN 'error' THEN 'DELETED' ELSE 'UNCHANGED' END AS change_type
        FROM (SELECT *, event_id % 4 AS k, (event_id // 4) % 8 AS g FROM events)"""
