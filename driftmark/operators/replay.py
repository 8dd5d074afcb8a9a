"""The state at a snapshot, rebuilt from the change log.

A key's newest log rows up to the snapshot say what became of it: where they are DELETED it is gone,
else they are its rows. Three rules of the difference have to be read backwards. A collision-safe
rename doesn't report the old name, but it needs the MD5 to be unique on both sides: whoever held the
MD5 before is the one that was renamed. A row can be RENAMED and MODIFIED in one snapshot; it counts
once. And rows without a full key are reported anew by every run, so the snapshot's own are all there
are.

The log doesn't tell everything: of a key with several rows only those that met another MD5 are in it,
and a baseline's views with columns are skipped once. A store therefore keeps a digest of each state,
and a rebuilt one is compared with it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftmark.operators.diff import CHANGE, LARGE_ROWS, MD5, PARENT_HASHES, has_key, row_columns
from driftmark.operators.joins import skew_join
from driftmark.operators.metrics import real_changes


def state_at(
    log: DataFrame,
    keys: Sequence[str],
    snapshot_id: int,
    *,
    collision_safe: bool,
    large_rows: int = LARGE_ROWS,
    settle: Callable[[str, DataFrame], DataFrame] = lambda _, df: df,
) -> DataFrame:
    """Fingerprint rows of one level at ``snapshot_id``, from that level's log rows.

    Without ``collision_safe`` all that a row's fate depends on has its key, so the rows move once, to
    their key. Keys that have more than ``large_rows`` rows take the general steps, which split them.
    """
    keys = list(keys)
    if collision_safe:
        return _state_in_steps(log, keys, snapshot_id, collision_safe=True, settle=settle)
    keyed = F.expr(has_key(keys))
    counted = log.where(keyed & (F.col("snapshot_id") <= snapshot_id)).groupBy(_key_hash(keys).alias("key")).count()
    large = [r.key for r in counted.where(F.col("count") > large_rows).collect()]
    if not large:
        return _state_by_key(log, keys, snapshot_id)
    apart = F.coalesce(keyed & _key_hash(keys).isin(large), F.lit(False))
    some = _state_in_steps(log.where(apart), keys, snapshot_id, collision_safe=False, settle=settle)
    return some.unionByName(_state_by_key(log.where(~apart), keys, snapshot_id))


def _key_hash(keys: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(PARENT_HASHES)).cast("int")


def _state_by_key(log: DataFrame, keys: Sequence[str], snapshot_id: int) -> DataFrame:
    """The rows that each key's newest log rows leave, from one exchange. Two 64-bit hashes stand for a
    key. Rows without a full key go along, dealt by all they hold."""
    row = row_columns(log)
    full = has_key(keys)
    events = real_changes(log).where(F.col("snapshot_id") <= snapshot_id)
    events = events.where(f"({full}) OR (snapshot_id = {int(snapshot_id)} AND {CHANGE} <> 'DELETED')")
    place = F.when(F.expr(full), F.xxhash64(*keys)).otherwise(F.xxhash64(*row))
    rows = events.select(*row, "snapshot_id", CHANGE).repartition(place)
    rows = rows.withColumns({"_p": place, "_k": F.xxhash64(F.lit("key"), *keys), "_m": F.xxhash64(F.lit("md5"), MD5)})
    version, key = Window.partitionBy("_p", "_k", "_m"), Window.partitionBy("_p", "_k")
    rows = rows.withColumn("last", F.max(F.struct("snapshot_id", CHANGE)).over(version))
    rows = rows.withColumn("newest", F.max("snapshot_id").over(key))
    left = f"snapshot_id = newest AND last.{CHANGE} <> 'DELETED' AND {CHANGE} = last.{CHANGE}"
    return rows.where(f"NOT ({full}) OR ({left})").select(*row)


def _state_in_steps(
    log: DataFrame,
    keys: Sequence[str],
    snapshot_id: int,
    *,
    collision_safe: bool,
    settle: Callable[[str, DataFrame], DataFrame],
) -> DataFrame:
    """The same from narrow rows, one for each key and MD5; only those alive at the snapshot are looked up
    in the log."""
    keys = list(keys)
    parent = keys[:-1]
    row = row_columns(log)
    events = real_changes(log).where(F.col("snapshot_id") <= snapshot_id)
    known = events.where(has_key(keys)).withColumns({"_md5": F.coalesce(MD5, F.lit("")), "_none": F.col(MD5).isNull()})
    version = [*keys, "_md5", "_none"]
    last = F.max(F.struct("snapshot_id", CHANGE)).alias("last")
    found = settle("replayed-versions", known.groupBy(*version).agg(last).select(*version, "last.*"))
    newest = found.groupBy(*keys).agg(F.max("snapshot_id").alias("newest"))
    alive = skew_join(found, newest, keys).where(f"snapshot_id = newest AND {CHANGE} <> 'DELETED'").drop("newest")
    if collision_safe:
        renamed = known.where((F.col(CHANGE) == "RENAMED") & ~F.col("_none"))
        renamed = renamed.groupBy(*parent, "_md5", "_none").agg(F.max("snapshot_id").alias("renamed"))
        alive = skew_join(alive, renamed, [*parent, "_md5", "_none"], "left")
        alive = alive.where("renamed IS NULL OR renamed <= snapshot_id").drop("renamed")
    alive = settle("replayed-keys", alive)
    rows = skew_join(known.select(*row, "_md5", "_none", "snapshot_id", CHANGE), alive, [*version, "snapshot_id", CHANGE], "left_semi")
    loose = events.where(f"NOT ({has_key(keys)})").where((F.col("snapshot_id") == snapshot_id) & (F.col(CHANGE) != "DELETED"))
    return rows.select(*row).unionByName(loose.select(*row))


def state_digest(rows: DataFrame) -> DataFrame:
    """Rows of a state and order-free sums of their hashes, in one row."""
    columns = row_columns(rows)
    filled = [F.coalesce(F.col(c), F.lit("\u0000")) for c in columns]
    sums = [F.coalesce(F.sum(F.xxhash64(F.lit(seed), *filled).cast("decimal(38,0)")), F.lit(0)) for seed in ("one", "other")]
    return rows.agg(F.count("*").alias("n_rows"), *[h.cast("string").alias(n) for h, n in zip(sums, ("h1", "h2"))])
