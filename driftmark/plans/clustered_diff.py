"""Difference of two staged snapshots that reads only clusters which may have changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from driftmark.operators import diff
from driftmark.sources.clustered import CLUSTER, ClusteredStates, co_partitioned

# A cluster with more rows is one large parent: it is compared by the plan that splits hot keys.
HOT_ROWS = 4_000_000

Settle = Callable[[str, DataFrame], DataFrame]


def clustered_changes(
    states: ClusteredStates,
    current: int,
    previous: int,
    *,
    settle: Settle,
    settle_clustered: Settle,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Change rows of ``current`` against ``previous``, the same as :func:`diff.diff_child` or
    :func:`diff.diff_entity` gives for the whole states.

    Digests tell which clusters to read. Their rows come from one bucketed scan, and every step keeps
    its partitioning, so neither keys nor details are exchanged. A cluster beyond ``hot_rows`` goes
    through the general plan, which spreads a parent's rows over all tasks.
    """
    rows = states.to_read(current, previous)
    hot = sorted(c for c, n in rows.items() if n > hot_rows)
    rest = sorted(c for c, n in rows.items() if n <= hot_rows)

    keys = [CLUSTER, *states.keys]

    def once(name: str, df: DataFrame) -> DataFrame:
        """Versions are used several times; what comes of them is cheap to compute where it is."""
        return settle_clustered(name, df) if name == "versions" else df

    with co_partitioned(states.spark):
        both = states.pair(current, previous, rest)
        located = diff.locate_in(both, keys, collision_safe=states.collision_safe, settle=once)
        found = settle("changes", diff.attach_in(located, both, keys))
    if hot:
        both = states.pair(current, previous, hot).drop(CLUSTER)

        def apart(name: str, df: DataFrame) -> DataFrame:
            return settle(f"hot-{name}", df)

        located = diff.locate_in(both, states.keys, collision_safe=states.collision_safe, settle=apart)
        found = found.unionByName(diff.attach_in(apart("located", located), both, states.keys))
    return found
