"""Difference of two states: ADDED, MODIFIED, RENAMED and DELETED rows.

A change row is emitted once per matching pair of current and previous rows. Pairs are never
built: how many there are follows from row counts per key and per MD5, so a change row carries its
number in ``copies`` (1 wherever keys are unique) and the work grows with the rows, not with
their pairs. :func:`expand_copies` gives the repeated rows where a consumer wants them.

The comparison runs in two steps:

1. :func:`locate_in` compares narrow rows, key and MD5 without the details text. Counting happens
   before the shuffle, so a hot key or MD5 arrives as one row per task. Untouched keys drop out
   here, and what goes on is as large as the change.
2. :func:`attach_in` looks the full rows up for the located keys. The located side is unique, so a
   key with many rows can be split by the adaptive skew join, and a small one is broadcast at the
   size Spark has measured.

All that a child's change depends on has its parent, and parents are mostly small. :func:`child_changes`
therefore brings whole parents together, once, and reads every count off windows there; only parents
that would make a task too long (:func:`large_parents`) take the two steps.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.joins import skew_join
from driftmark.schemas import CHILD_KEYS, DB, ENTITY_KEYS, FINGERPRINT_COLUMNS

MD5 = "object_md5"
CHANGE = "change_type"
PREVIOUS_NAME = "prev_object_type_name"
CHANGE_TYPES = ("RENAMED", "MODIFIED", "ADDED", "DELETED")
# Parents are counted by a hash of this many values; beyond so many rows one of them is large.
PARENT_HASHES = 1 << 16
LARGE_ROWS = 2_000_000


def _scoped(current: DataFrame, keys: Sequence[str]) -> list[str]:
    return [*([DB] if DB in current.columns else []), *keys]


def has_key(keys: Sequence[str]) -> str:
    """NULL equals nothing: a row with a NULL in its key can't match."""
    return " AND ".join(f"{k} IS NOT NULL" for k in keys)


def sides(current: DataFrame, previous: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of both states, those of the previous one marked ``gone``."""
    return current.selectExpr(*columns, "false as gone").unionByName(previous.selectExpr(*columns, "true as gone"))


def versions_in(both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key and MD5 with the number of rows on each side (``n_cur``, ``n_prev``). Rows
    without an MD5 are a version of their own: they have the key, but equal and differ from nothing."""
    present = both.where(has_key(keys)).selectExpr(
        *keys, MD5, "cast(NOT gone as bigint) as in_cur", "cast(gone as bigint) as in_prev"
    )
    return present.groupBy(*keys, MD5).agg(F.expr("sum(in_cur) as n_cur"), F.expr("sum(in_prev) as n_prev"))


def versions(current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`versions_in` two states."""
    return versions_in(sides(current, previous, [*keys, MD5]), keys)


def _totals(v: DataFrame, by: Sequence[str], prefix: str) -> DataFrame:
    return v.groupBy(*by).agg(
        F.expr(f"sum(n_cur) as {prefix}_cur"),
        F.expr(f"sum(n_prev) as {prefix}_prev"),
        F.expr(f"sum(CASE WHEN {MD5} IS NOT NULL THEN n_prev ELSE 0 END) as {prefix}_set"),
        F.expr(f"count(*) as {prefix}_rows"),
    )


def md5_counts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows per schema, type and MD5 on both sides; 0 where a side has none."""
    keys = _scoped(current, ENTITY_KEYS)
    by = [*keys[:-1], MD5]
    return _totals(versions(current, previous, keys), by, "md5").select(*by, "md5_cur", "md5_prev")


def name_counts(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows per schema, type and name on both sides; 0 where a side has none."""
    keys = _scoped(current, ENTITY_KEYS)
    return _totals(versions(current, previous, keys), keys, "name").select(*keys, "name_cur", "name_prev")


def locate_in(
    both: DataFrame,
    keys: Sequence[str],
    *,
    collision_safe: bool,
    unchanged: bool = False,
    settle: Callable[[str, DataFrame], DataFrame] = lambda _, df: df,
) -> DataFrame:
    """Key, MD5, change type, copies and previous name of every change in the rows of two
    :func:`sides`; at most one row per key, MD5 and change type.

    The last key is the object's own name. Without ``collision_safe`` each current row is RENAMED
    once per previous row with its parent and MD5 but another name, and MODIFIED once per previous
    row with its key but another MD5; the old name of a rename is DELETED as well. With it a
    rename needs the MD5 to be unique on both sides, a modification the name, and the old name of
    a rename is not reported again.

    ``settle`` may write an intermediate result and return it as read back. The versions are then
    shuffled once for all their uses, and what they are joined with has a measured size.
    """
    keys = list(keys)
    *parent, name = keys
    out = [*keys, MD5, CHANGE, "copies", PREVIOUS_NAME]
    v = settle("versions", versions_in(both, keys))

    # A key is untouched when one version of it is on both sides; an MD5 is a candidate for a
    # rename when several names hold it and it is on both sides.
    by_key = settle(
        "touched_keys", _totals(v, keys, "key").where("key_rows > 1 OR key_cur = 0 OR key_prev = 0")
    )
    by_md5 = settle(
        "shared_md5s",
        _totals(v.where(f"{MD5} IS NOT NULL"), [*parent, MD5], "md5").where(
            "md5_rows > 1 AND md5_cur > 0 AND md5_prev > 0"
        ),
    )

    if collision_safe:
        pairs = (
            skew_join(v, by_md5.where("md5_cur = 1 AND md5_prev = 1"), [*parent, MD5])
            .groupBy(*parent, MD5)
            .agg(
                F.expr(f"max(CASE WHEN n_cur = 1 THEN {name} END) as new_name"),
                F.expr(f"max(CASE WHEN n_prev = 1 THEN {name} END) as old_name"),
            )
        )
        renamed = pairs.selectExpr(
            *parent, f"new_name as {name}", MD5, f"'RENAMED' as {CHANGE}", "1L as copies", f"old_name as {PREVIOUS_NAME}"
        )
        taken = pairs.selectExpr(
            *parent, f"stack(2, new_name, 'ADDED', old_name, 'DELETED') as ({name}, {CHANGE})"
        )
        modified, modified_copies = "key_cur = 1 AND key_prev = 1 AND key_set = 1 AND n_cur = 1", "1L"
    else:
        renamed = (
            skew_join(v, by_md5, [*parent, MD5])
            .where("n_cur > 0 AND md5_prev > n_prev")
            .selectExpr(
                *keys, MD5, f"'RENAMED' as {CHANGE}", "md5_prev - n_prev as copies",
                f"cast(NULL as string) as {PREVIOUS_NAME}",
            )
        )
        taken = renamed.selectExpr(*keys, f"'ADDED' as {CHANGE}")
        modified, modified_copies = "n_cur > 0 AND key_set > n_prev", "key_set - n_prev"

    at_key = skew_join(v, by_key, keys).selectExpr(
        "*",
        f"CASE WHEN {MD5} IS NOT NULL AND {modified} THEN 'MODIFIED' WHEN key_prev = 0 THEN 'ADDED' "
        f"WHEN key_cur = 0 THEN 'DELETED' END as {CHANGE}",
    )
    other = skew_join(
        at_key.where(f"{CHANGE} IS NOT NULL"), taken.distinct(), [*keys, CHANGE], "left_anti"
    ).selectExpr(
        *keys,
        MD5,
        CHANGE,
        f"CASE WHEN {CHANGE} = 'MODIFIED' THEN {modified_copies} ELSE 1L END as copies",
        f"CASE WHEN {CHANGE} <> 'ADDED' THEN {name} END as {PREVIOUS_NAME}",
    )
    located = renamed.select(*out).unionByName(other)
    if unchanged:
        same = v.where(f"{MD5} IS NOT NULL AND n_cur > 0 AND n_prev > 0").selectExpr(
            *keys, MD5, f"'UNCHANGED' as {CHANGE}", "n_prev as copies", f"{name} as {PREVIOUS_NAME}"
        )
        located = located.unionByName(same)
    return located


def locate(current: DataFrame, previous: DataFrame, keys: Sequence[str], **options) -> DataFrame:
    """:func:`locate_in` two states."""
    return locate_in(sides(current, previous, [*keys, MD5]), keys, **options)


def row_columns(rows: DataFrame) -> list[str]:
    """Columns of a fingerprint row, with the database where rows have one."""
    return [c for c in (DB, *FINGERPRINT_COLUMNS) if c in rows.columns]


def attach_in(located: DataFrame, both: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full change rows for located keys, and the rows that a NULL key sets apart, from the rows of
    two :func:`sides`. Located keys without an MD5 take the rows that have none."""
    keys = list(keys)
    row = row_columns(both)
    out = [*row, CHANGE, "copies", PREVIOUS_NAME]
    md5 = [f"coalesce({MD5}, '') as _md5", f"{MD5} IS NULL as _no_md5"]
    at = located.selectExpr("*", f"{CHANGE} = 'DELETED' as gone", *md5).drop(MD5)
    found = both.where(has_key(keys)).selectExpr("*", *md5).join(at, [*keys, "_md5", "_no_md5", "gone"])
    loose = both.where(f"NOT ({has_key(keys)})").selectExpr(
        *row,
        f"CASE WHEN gone THEN 'DELETED' ELSE 'ADDED' END as {CHANGE}",
        "1L as copies",
        f"CASE WHEN gone THEN {keys[-1]} END as {PREVIOUS_NAME}",
    )
    return found.select(*out).unionByName(loose)


def attach(located: DataFrame, current: DataFrame, previous: DataFrame, keys: Sequence[str]) -> DataFrame:
    """:func:`attach_in` two states."""
    return attach_in(located, sides(current, previous, row_columns(current)), keys)


def _parent_hash(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys[:-1]), F.lit(PARENT_HASHES)).cast("int")


def large_parents(both: DataFrame, keys: Sequence[str], large_rows: int = LARGE_ROWS) -> list[int]:
    """Hashes of the parents with more than ``large_rows`` rows: at most one for each so many rows of
    the states. Rows are counted before the shuffle."""
    counted = both.groupBy(F.when(F.expr(has_key(keys)), _parent_hash(keys)).alias("parent")).count()
    return [r.parent for r in counted.where(F.col("parent").isNotNull() & (F.col("count") > large_rows)).collect()]


def child_changes(both: DataFrame, keys: Sequence[str], *, unchanged: bool = False) -> DataFrame:
    """What :func:`locate_in` without ``collision_safe`` and :func:`attach_in` give for the rows of two
    :func:`sides`, from one exchange of the rows by their parent.

    In the windows two 64-bit hashes stand for a key, or for an MD5 of a parent: rows are sorted and told
    apart by numbers. Hashes are taken after the exchange, so they don't move. Rows without a full key
    go along, dealt by all they hold, so that the states are read once.
    """
    keys = list(keys)
    *parent, name = keys
    row = row_columns(both)
    keyed = has_key(keys)
    place = F.when(F.expr(keyed), F.xxhash64(*parent)).otherwise(F.xxhash64(*row))
    rows = both.select(*row, "gone").repartition(place)
    rows = rows.withColumns({"_p": place, "_m": F.xxhash64(F.lit("md5"), MD5), "_k": F.xxhash64(F.lit("key"), *keys)})
    version, md5, key = (Window.partitionBy("_p", *by) for by in (("_m", "_k"), ("_m",), ("_k",)))
    is_set = F.col(MD5).isNotNull()
    rows = rows.withColumn("n_prev", F.count_if("gone").over(version))
    rows = rows.withColumn("renames", F.when(is_set, F.count_if("gone").over(md5) - F.col("n_prev")).otherwise(0))
    rows = rows.withColumns(
        {
            "key_cur": F.count_if(~F.col("gone")).over(key),
            "key_prev": F.count_if("gone").over(key),
            "key_set": F.count_if(F.col("gone") & is_set).over(key),
            "key_renames": F.max(F.when(F.col("gone"), 0).otherwise(F.col("renames"))).over(key),
        }
    )
    full = f"({keyed})"
    found = {
        "RENAMED": (f"{full} AND NOT gone AND renames > 0", "renames"),
        "MODIFIED": (f"{full} AND NOT gone AND {MD5} IS NOT NULL AND key_set > n_prev", "key_set - n_prev"),
        "ADDED": (f"NOT gone AND (NOT {full} OR key_prev = 0 AND key_renames = 0)", "1L"),
        "DELETED": (f"gone AND (NOT {full} OR key_cur = 0)", "1L"),
    }
    if unchanged:
        found["UNCHANGED"] = (f"{full} AND NOT gone AND {MD5} IS NOT NULL AND n_prev > 0", "n_prev")
    cases = ", ".join(
        f"CASE WHEN {met} THEN struct('{change}' as {CHANGE}, {n} as copies) END" for change, (met, n) in found.items()
    )
    rows = rows.where(" OR ".join(f"({met})" for met, _ in found.values()))
    rows = rows.select(*row, F.expr(f"inline(filter(array({cases}), c -> c IS NOT NULL))"))
    previous_name = F.when(F.col(CHANGE).isin("MODIFIED", "DELETED", "UNCHANGED"), F.col(name))
    return rows.select(*row, CHANGE, "copies", previous_name.alias(PREVIOUS_NAME))


def changes_in(
    both: DataFrame,
    keys: Sequence[str],
    *,
    unchanged: bool = False,
    large_rows: int = LARGE_ROWS,
    settle: Callable[[str, DataFrame], DataFrame] = lambda _, df: df,
) -> DataFrame:
    """Child-level change rows of two :func:`sides`: small parents by :func:`child_changes`, large ones
    by the general steps, which split them."""
    large = large_parents(both, keys, large_rows)
    if not large:
        return child_changes(both, keys, unchanged=unchanged)
    apart = F.expr(has_key(keys)) & _parent_hash(keys).isin(large)
    some = both.where(apart)
    located = locate_in(some, keys, collision_safe=False, unchanged=unchanged, settle=settle)
    found = attach_in(settle("located", located), some, keys)
    return found.unionByName(child_changes(both.where(~F.coalesce(apart, F.lit(False))), keys, unchanged=unchanged))


def diff_child(
    current: DataFrame, previous: DataFrame, *, collision_safe: bool = False, unchanged: bool = False
) -> DataFrame:
    """Child-level changes: fingerprint row, ``change_type`` and ``copies``."""
    keys = _scoped(current, CHILD_KEYS)
    if not collision_safe:
        both = sides(current, previous, row_columns(current))
        return changes_in(both, keys, unchanged=unchanged).drop(PREVIOUS_NAME)
    located = locate(current, previous, keys, collision_safe=collision_safe, unchanged=unchanged)
    return attach(located, current, previous, keys).drop(PREVIOUS_NAME)


def diff_entity(current: DataFrame, previous: DataFrame, *, unchanged: bool = False) -> DataFrame:
    """Entity-level, collision-safe changes; also the name an object had before."""
    keys = _scoped(current, ENTITY_KEYS)
    located = locate(current, previous, keys, collision_safe=True, unchanged=unchanged)
    return attach(located, current, previous, keys)


def child_processed(changes: DataFrame) -> DataFrame:
    """Child keys that a rename (by its new name) or a modification has accounted for."""
    keys = _scoped(changes, CHILD_KEYS)
    return changes.where(F.col(CHANGE).isin("RENAMED", "MODIFIED")).select(*keys).distinct()


def entity_processed(changes: DataFrame) -> DataFrame:
    """Entity keys accounted for: both names of a rename and the name of a modification."""
    keys = _scoped(changes, ENTITY_KEYS)
    *parent, name = keys
    return (
        changes.where(F.col(CHANGE).isin("RENAMED", "MODIFIED"))
        .select(*parent, F.explode(F.array(name, PREVIOUS_NAME)).alias(name))
        .distinct()
    )


def diff_unify(*parts: DataFrame) -> DataFrame:
    """Changes of several diffs as one log, without the previous name."""
    out = None
    for part in parts:
        part = part.drop(PREVIOUS_NAME)
        out = part if out is None else out.unionByName(part)
    return out


def expand_copies(changes: DataFrame) -> DataFrame:
    """One row per log row in place of ``copies``; the output is as long as the log.

    Repetition is by two generators of at most 65536 steps, so no row builds a long array.
    """
    step = 65536
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / step)))
    left = F.least(F.lit(step).cast("long"), F.col("copies") - F.col("_block") * step)
    return (
        changes.withColumn("_block", block)
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), left)))
        .drop("_block", "_copy", "copies")
    )
