"""A snapshot run: stage the current state, compare it with the last one, log, count, register."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftmark.operators import diff
from driftmark.operators.fingerprints import repeated, union_child, union_current, union_entity
from driftmark.operators.metrics import metrics_run
from driftmark.operators.routing import route_state
from driftmark.operators.scope import Entries, scope_exclude, scope_include
from driftmark.plans.clustered_diff import clustered_changes
from driftmark.schemas import CHILD_KEYS, DB, ENTITY_KEYS
from driftmark.sources.extracts import Extracts
from driftmark.sources.store import (
    METRICS,
    RUN_REPORT,
    STATE_CHILD,
    STATE_ENTITY,
    SnapshotStore,
)

OWN = "driftmark"
"""The engine's own schema, which a run leaves out."""

# What the run report calls the two kinds of run.
FIRST_RUN, LATER_RUN = "Initial Load", "Subsequent Compare Run"


def baseline_changes(rows: DataFrame) -> DataFrame:
    """Every row of a first state as ADDED."""
    return rows.withColumns({"change_type": F.lit("ADDED"), "copies": F.lit(1).cast("long")})


def distinct_as_written(rows: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Distinct rows, written. Mostly none repeats, which hashes of the written rows tell; so whole rows are
    shuffled only where some do, and then they are computed and written again."""
    written = write(rows)
    return written if repeated(written.select(*rows.columns)).isEmpty() else write(rows.distinct())


@dataclass
class CurrentState:
    """The state to compare. ``everything`` is what a baseline stages and logs; ``child`` and
    ``entity`` are what later runs compare. With ``repeats`` equal rows stand for one object, and a
    run makes them distinct as it writes them."""

    child: DataFrame
    entity: DataFrame
    everything: DataFrame
    repeats: bool = False

    @classmethod
    def of_catalog(cls, extracts: Extracts, schemas=None) -> CurrentState:
        unions = [union(extracts, schemas, distinct=False) for union in (union_child, union_entity, union_current)]
        return cls(*unions, repeats=True)

    @classmethod
    def of_rows(cls, child: DataFrame, entity: DataFrame) -> CurrentState:
        return cls(child, entity, child.unionByName(entity))


@dataclass
class _Steps:
    """Steps of a run with result and duration."""

    rows: list[tuple[str, str, float]] = field(default_factory=list)

    def __call__(self, name: str, action: Callable[[], Any], result: str = "Completed") -> Any:
        started = time.monotonic()
        value = action()
        self.rows.append((name, result, time.monotonic() - started))
        return value


def _log_diff(
    store: SnapshotStore, snapshot_id: int, name: str, current: DataFrame, previous: DataFrame, keys, safe: bool
) -> DataFrame:
    """Change rows of one level. Children move once, to their parent. Elsewhere intermediate results are
    written: each is computed once, a lost executor costs no more than its own tasks, and measured sizes
    decide whether the full rows have to move at all."""
    keys = [*([DB] if DB in current.columns else []), *keys]

    def settle(part: str, df: DataFrame) -> DataFrame:
        return store.write_scratch(f"{part}-{name}-{snapshot_id}", df)

    if not safe:
        both = diff.sides(current, previous, diff.row_columns(current))
        return diff.changes_in(both, keys, settle=settle)
    located = diff.locate(current, previous, keys, collision_safe=safe, settle=settle)
    return diff.attach(settle("located", located), current, previous, keys)


def _log_clustered(store: SnapshotStore, table: str, snapshot_id: int, last: int) -> DataFrame:
    """Change rows of one level from clustered states."""
    settle, forget = store.settle_clustered(f"clustered-{table}-{snapshot_id}")
    found = clustered_changes(
        store.clustered[table],
        snapshot_id,
        last,
        settle=lambda name, df: store.write_scratch(f"{name}-{table}-{snapshot_id}", df),
        settle_clustered=settle,
    )
    forget()
    return found


def scope_relation(extracts: Extracts, schemas: Entries = (), mode: str = "exclude", own: str = OWN) -> DataFrame:
    """The schemas that a run looks at, as a relation of one ``entry`` each: the listed ones that exist
    (``include``), or all user schemas but the engine's own and the listed ones (``exclude``). A name
    means the same in every database, so one scope covers all of them."""
    rules = {
        "include": lambda schemata: scope_include(schemata, schemas),
        "exclude": lambda schemata: scope_exclude(schemata, schemas, own),
    }
    if mode not in rules:
        raise ValueError(f"unknown scope mode: {mode}")
    return rules[mode](extracts["schemata"]).select(F.col("schema_name").alias("entry")).distinct()


def resolve_scope(extracts: Extracts, schemas: Entries = (), mode: str = "exclude", own: str = OWN) -> list[str]:
    """Names of the schemas in :func:`scope_relation`, sorted."""
    return sorted(r.entry for r in scope_relation(extracts, schemas, mode, own).collect())


def run(
    store: SnapshotStore,
    current: CurrentState | Extracts,
    *,
    schemas: Entries = (),
    mode: str = "exclude",
    own: str = OWN,
    now: datetime | None = None,
    once_daily: bool = False,
    allow_cleanup: bool = False,
    on_step: Callable[[str], None] | None = None,
) -> int | None:
    """Take a snapshot and return its id, or None when ``once_daily`` skips the run.

    Catalog extracts are looked at in the schemas that ``schemas`` and ``mode`` choose; a state given
    as rows is taken as it is. Where the predecessor has no staged state any more, because a later
    snapshot retired it and was rolled back, it is rebuilt from the log first; the run is refused if
    that doesn't give the state that was staged, since it would report what hasn't changed.

    The first run stages and logs everything as ADDED, later ones log the difference. Whatever
    fails, the new snapshot is removed again and the last one stays as it was: old staged rows
    go only after the new snapshot is registered. ``on_step`` hears of each step before it.
    """
    now = now or datetime.now()
    if once_daily and store.ran_on(now.date()):
        return None
    steps = _Steps()

    def step(name: str, action: Callable[[], Any], result: str = "Completed") -> Any:
        if on_step is not None:
            on_step(name)
        return steps(name, action, result)

    if not isinstance(current, CurrentState):
        extracts = current
        scope = step("resolve_scope", lambda: store.write_scratch("scope", scope_relation(extracts, schemas, mode, own)))
        if scope.isEmpty():
            # Some kinds read an empty list as "all".
            raise ValueError("the scope has no schema")
        current = CurrentState.of_catalog(extracts, scope)
    last = store.latest()
    if last is not None and not all(last in store.partitions(t) for t in (STATE_CHILD, STATE_ENTITY)):
        step("restage", lambda: store.restage(last), f"Rebuilt {last}")
    step("mode", lambda: None, FIRST_RUN if last is None else LATER_RUN)
    if last is None:
        step("clean_orphans", lambda: store.clean_orphans(allow=allow_cleanup))
    else:
        step("retain_previous", lambda: store.retain_latest(last), f"Kept {last}")
    n, name = store.next_snapshot(now)

    def once(rows: DataFrame, write: Callable[[DataFrame], DataFrame]) -> DataFrame:
        return distinct_as_written(rows, write) if current.repeats else write(rows)

    def stage(table: str, rows: DataFrame) -> DataFrame:
        return store.write_state(table, n, rows, now)

    try:
        if last is None:
            # Both states and the log hold the same rows: they are computed once, and written as the log's.
            everything = step(
                "read_current",
                lambda: once(current.everything, lambda rows: store.write_pending_changes(n, baseline_changes(rows), now)),
            )
            to_child, to_entity = route_state(everything)
            child = step(f"stage_{STATE_CHILD}", lambda: stage(STATE_CHILD, to_child))
            entity = step(f"stage_{STATE_ENTITY}", lambda: stage(STATE_ENTITY, to_entity))
            log = step("log_baseline", lambda: store.log_pending_changes(n))
        else:
            child, entity = (
                step(f"stage_{table}", lambda: once(rows, lambda found: stage(table, found)))
                for table, rows in ((STATE_CHILD, current.child), (STATE_ENTITY, current.entity))
            )
            old_child = store.read_snapshot(STATE_CHILD, last)
            old_entity = store.read_snapshot(STATE_ENTITY, last)

            def compare(table: str, level: str, now: DataFrame, before: DataFrame, keys, safe: bool) -> DataFrame:
                if table in store.clustered and store.clustered[table].holds(last):
                    return _log_clustered(store, table, n, last)
                return _log_diff(store, n, level, now, before, keys, safe)

            by_child = step(
                "compare_child", lambda: compare(STATE_CHILD, "child", child, old_child, CHILD_KEYS, False)
            )
            by_entity = step(
                "compare_entity", lambda: compare(STATE_ENTITY, "entity", entity, old_entity, ENTITY_KEYS, True)
            )
            log = step(
                "log_changes", lambda: store.write_changes(n, diff.diff_unify(by_child, by_entity), now)
            )
        step("digest", lambda: store.write_digests(n))
        step(METRICS, lambda: store.upsert_metrics(n, metrics_run(log, child, entity), now))
        step("register", lambda: store.register(n, name, now))
    except BaseException:
        store.rollback(n)
        raise
    finally:
        store.drop_scratch()
    step("retain", lambda: store.retain_latest(n), f"Kept {n}")
    report = [(i, *row) for i, row in enumerate(steps.rows, 1)]
    columns = "step_no int, step_name string, result string, seconds double"
    store.write_snapshot(RUN_REPORT, n, store.spark.createDataFrame(report, columns).coalesce(1))
    return n
