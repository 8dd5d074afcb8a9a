"""Metrics of one snapshot: rows (snapshot_id, metric_name, metric_value)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftmark.schemas import DB

# The metric names and what each one counts.
CHANGE_WORDS = {"Added": "ADDED", "Modified": "MODIFIED", "Dropped": "DELETED", "Renamed": "RENAMED"}

OBJECT_KINDS = (  # label, object type, subtype
    ("Columns", None, "COLUMN"),
    ("Constraints", None, "CONSTRAINT"),
    ("Indexes", None, "INDEX"),
    ("References", None, "REFERENCE"),
    ("Triggers", None, "TRIGGER"),
    ("Functions", "FUNCTION", None),
    ("Views", "VIEW", None),
    ("Materialized Views", "MATERIALIZED VIEW", None),
    ("Table Sequences", "TABLE", "SEQUENCE"),
    ("Schema Sequences", "SEQUENCE", None),
)


def _scope(df: DataFrame) -> list[str]:
    return [c for c in (DB, "snapshot_id") if c in df.columns]


def copies(df: DataFrame) -> Column:
    """How many log rows a row stands for: 1 in a log without the column."""
    return F.col("copies") if "copies" in df.columns else F.lit(1).cast("long")


def real_changes(changes: DataFrame) -> DataFrame:
    return changes.where(F.col("change_type") != "UNCHANGED")


def _long_form(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """One row per metric from one column per metric."""
    pairs = [F.struct(F.lit(n).alias("metric_name"), F.col(c).alias("metric_value")) for n, c in names.items()]
    return df.select(*_scope(df), F.explode(F.array(*pairs)).alias("m")).select(*_scope(df), "m.*")


def metrics_base(changes: DataFrame, *staged: DataFrame) -> DataFrame:
    """Schemas staged, schemas with changes, and change rows.

    Staged and changed schemas are reduced to one row per schema before they meet.
    """
    scope = _scope(changes)
    zero = F.lit(0).cast("long")
    seen = reduce(
        DataFrame.unionByName,
        [s.select(*scope, "schema_name", F.lit(1).alias("staged"), zero.alias("n")) for s in staged],
    )
    real = real_changes(changes)
    hit = real.select(*scope, "schema_name", F.lit(0).alias("staged"), copies(real).alias("n"))
    per_schema = (
        seen.unionByName(hit)
        .groupBy(*scope, "schema_name")
        .agg(F.max("staged").alias("staged"), F.sum("n").alias("n"))
    )
    totals = per_schema.groupBy(*scope).agg(
        F.coalesce(F.sum(F.col("staged").cast("long")), zero).alias("monitored"),
        F.count_if((F.col("n") > 0) & F.col("schema_name").isNotNull()).alias("changed"),
        F.coalesce(F.sum("n"), zero).alias("total"),
    )
    return _long_form(
        totals,
        {
            "Schemas Monitored": "monitored",
            "Schemas With Changes": "changed",
            "Total Change Operations": "total",
        },
    )


def metrics_table(changes: DataFrame) -> DataFrame:
    """Distinct table names with any change and with each change type; zeros are kept.

    Names are reduced to one row of flags first, so one pass serves all five counts. The schema
    is not part of the count: tables of one name in two schemas count once. Rows of other objects
    fold into one unnamed row, which keeps the zeros of a snapshot without table changes.
    """
    scope = _scope(changes)
    words = {f"Tables {word}": change for word, change in CHANGE_WORDS.items()}
    table = F.when(F.upper("object_type") == "TABLE", F.col("object_type_name"))
    flags = (
        real_changes(changes)
        .groupBy(*scope, table.alias("table_name"))
        .agg(*[F.max((F.col("change_type") == c).cast("long")).alias(c) for c in words.values()])
    )
    named = F.col("table_name").isNotNull()
    totals = flags.groupBy(*scope).agg(
        F.count("table_name").alias("any"),
        *[F.count_if(named & (F.col(c) == 1)).alias(c) for c in words.values()],
    )
    return _long_form(totals, {"Tables With Changes": "any", **words})


def metrics_object(changes: DataFrame) -> DataFrame:
    """Change rows per kind of object and change type; a label without rows is absent.

    A kind with an object type takes rows of that type whose subtype is the kind's (none when the
    kind has none); a kind with a subtype takes every row of that subtype. Rows are counted per
    type, subtype and change before they meet the 40 labels.
    """
    scope = _scope(changes)
    real = real_changes(changes)
    counted = (
        real.groupBy(
            *scope,
            F.upper("object_type").alias("obj_type"),
            F.upper(F.coalesce("object_subtype", F.lit(""))).alias("obj_subtype"),
            "change_type",
        )
        .agg(F.sum(copies(real)).alias("n"))
    )
    config = changes.sparkSession.createDataFrame(
        [
            (f"{kind} {word}", t, s, change)
            for kind, t, s in OBJECT_KINDS
            for word, change in CHANGE_WORDS.items()
        ],
        "metric_name string, cfg_type string, cfg_subtype string, change_type string",
    )
    same_type = (F.col("obj_type") == F.col("cfg_type")) & (
        F.col("obj_subtype") == F.coalesce("cfg_subtype", F.lit(""))
    )
    same_subtype = F.col("obj_subtype") == F.col("cfg_subtype")
    return (
        counted.join(F.broadcast(config), "change_type")  # 40 rows, a fixed list
        .where(F.coalesce(same_type, F.lit(False)) | F.coalesce(same_subtype, F.lit(False)))
        .groupBy(*scope, "metric_name")
        .agg(F.sum("n").alias("metric_value"))
    )


def tally(changes: DataFrame, *staged: DataFrame) -> DataFrame:
    """Everything the metrics need from the log and the staged rows, read once: rows per schema, type,
    table name, subtype and change (``n``, ``n_log``), and whether the schema was staged."""
    scope = _scope(changes)
    real = real_changes(changes)
    log = real.select(
        *scope,
        "schema_name",
        F.upper("object_type").alias("obj_type"),
        F.when(F.upper("object_type") == "TABLE", F.col("object_type_name")).alias("table_name"),
        F.upper(F.coalesce("object_subtype", F.lit(""))).alias("obj_subtype"),
        "change_type",
        copies(real).alias("n"),
        F.lit(1).cast("long").alias("n_log"),
        F.lit(0).cast("long").alias("staged"),
    )
    none = F.lit(None).cast("string")
    for rows in staged:
        log = log.unionByName(
            rows.select(
                *scope,
                "schema_name",
                *[none.alias(c) for c in _KINDS[1:]],
                F.lit(0).cast("long").alias("n"),
                F.lit(0).cast("long").alias("n_log"),
                F.lit(1).cast("long").alias("staged"),
            )
        )
    return log.groupBy(*scope, *_KINDS).agg(F.sum("n").alias("n"), F.sum("n_log").alias("n_log"), F.max("staged").alias("staged"))


_KINDS = ("schema_name", "obj_type", "table_name", "obj_subtype", "change_type")


def _metric(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("metric_name"), value.cast("long").alias("metric_value"))


def metrics_run(changes: DataFrame, *staged: DataFrame) -> DataFrame:
    """All metrics of a snapshot: the base ones always, the others where there are changes.

    The log is read once. Its tally is grouped by schema, by table name and by kind of object in one
    expansion; each group says what it adds to which metric.
    """
    scope = _scope(changes)
    flags = {c: f"is_{c.lower()}" for c in CHANGE_WORDS.values()}
    rows = tally(changes, *staged).withColumns({f: (F.col("change_type") == c).cast("long") for c, f in flags.items()})
    by_schema, by_table = [*scope, "schema_name"], [*scope, "table_name"]
    by_kind = [*scope, "obj_type", "obj_subtype", "change_type"]
    groups = rows.groupingSets([by_schema, by_table, by_kind], *scope, *_KINDS).agg(
        F.grouping_id().alias("level"),
        F.sum("n").alias("n"),
        F.sum("n_log").alias("n_log"),
        F.max("staged").alias("staged"),
        *[F.max(f).alias(f) for f in flags.values()],
    )

    def level(by: list[str]) -> Column:
        return F.col("level") == sum(1 << i for i, c in enumerate(reversed(_KINDS)) if c not in by)

    changed = (F.col("n") > 0) & F.col("schema_name").isNotNull()
    base = [
        _metric("Schemas Monitored", F.col("staged")),
        _metric("Schemas With Changes", changed),
        _metric("Total Change Operations", F.col("n")),
    ]
    named = F.col("table_name").isNotNull()
    tables = [_metric("Tables With Changes", named)]
    tables += [_metric(f"Tables {word}", named & (F.col(flags[c]) == 1)) for word, c in CHANGE_WORDS.items()]
    objects = [
        F.when(_is_kind(t, s) & (F.col("change_type") == change), _metric(f"{kind} {word}", F.col("n")))
        for kind, t, s in OBJECT_KINDS
        for word, change in CHANGE_WORDS.items()
    ]
    added = (
        F.when(level(by_schema), F.array(*base))
        .when(level(by_table) & (F.col("n_log") > 0), F.array(*tables))
        .when(level(by_kind) & (F.col("n_log") > 0), F.filter(F.array(*objects), lambda m: m.isNotNull()))
    )
    found = groups.select(*scope, F.explode(added).alias("m")).select(*scope, "m.*")
    if not scope:
        # Without a snapshot to group by, the base metrics are there even for empty tables.
        nothing = changes.sparkSession.range(1).select(F.explode(F.array(*[_metric(n, F.lit(0)) for n in _BASE])).alias("m"))
        found = found.unionByName(nothing.select("m.*"))
    return found.groupBy(*scope, "metric_name").agg(F.sum("metric_value").alias("metric_value"))


_BASE = ("Schemas Monitored", "Schemas With Changes", "Total Change Operations")


def _is_kind(object_type: str | None, subtype: str | None) -> Column:
    """Rows of the kind's type whose subtype is the kind's (none when it has none), or every row of its
    subtype."""
    of_type = F.lit(False) if object_type is None else (F.col("obj_type") == object_type) & (F.col("obj_subtype") == (subtype or ""))
    return of_type if subtype is None else of_type | (F.col("obj_subtype") == subtype)
