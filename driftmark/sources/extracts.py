"""Catalog extracts: the relations a database's catalog was exported to, for any number of databases."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.schemas import DB, EXTRACT_SCHEMAS, with_db

Extracts = Mapping[str, DataFrame]
"""Relation name to frame; every frame has ``source_db``."""


class LazyExtracts(Mapping):
    """Extracts whose frames are made when first asked for."""

    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]]):
        self._builders = dict(builders)
        self._frames: dict[str, DataFrame] = {}

    def __getitem__(self, relation: str) -> DataFrame:
        if relation not in self._frames:
            self._frames[relation] = self._builders[relation]()
        return self._frames[relation]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def read_extracts(
    spark: SparkSession,
    root: str,
    databases: Iterable[str] | None = None,
    relations: Iterable[str] = tuple(EXTRACT_SCHEMAS),
) -> LazyExtracts:
    """Read ``<root>/<relation>/source_db=<name>/*.parquet`` with declared schemas.

    ``databases`` prunes partitions, so other databases' files are not opened.
    """

    def read(relation: str) -> DataFrame:
        df = spark.read.schema(with_db(EXTRACT_SCHEMAS[relation])).parquet(f"{root}/{relation}")
        return df if databases is None else df.where(F.col(DB).isin(list(databases)))

    return LazyExtracts({relation: partial(read, relation) for relation in relations})


def write_extracts(extracts: Extracts, root: str) -> None:
    """Store extracts in the layout :func:`read_extracts` reads."""
    for relation, df in extracts.items():
        df.write.mode("overwrite").partitionBy(DB).parquet(f"{root}/{relation}")


def combine_databases(parts: Mapping[str, Extracts]) -> LazyExtracts:
    """Extracts of single databases, without or with ``source_db``, as one set.

    The key of ``parts`` becomes ``source_db``; later steps join and group on it, so one job
    covers every database.
    """

    def union(relation: str) -> DataFrame:
        tagged = [x[relation].withColumn(DB, F.lit(db)) for db, x in parts.items() if relation in x]
        return reduce(DataFrame.unionByName, tagged)

    relations = dict.fromkeys(relation for x in parts.values() for relation in x)
    return LazyExtracts({relation: partial(union, relation) for relation in relations})
