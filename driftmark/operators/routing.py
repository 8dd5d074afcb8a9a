"""Where a baseline stages a row: with the children, the entities, or both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHILD_SUBTYPES = ("Column", "Constraint", "Index", "Reference", "Trigger")
ENTITY_TYPES = ("Function", "View", "Materialized View", "Sequence")


def is_child() -> Column:
    """Rows that a baseline stages as children."""
    subtype = F.col("object_subtype")
    return subtype.isin(*CHILD_SUBTYPES) | ((F.col("object_type") == "Table") & (subtype == "Sequence"))


def is_entity() -> Column:
    """Rows that a baseline stages as entities. Columns of views pass both rules, so a baseline
    holds them twice; later runs don't."""
    return F.col("object_type").isin(*ENTITY_TYPES)


def route_state(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Child and entity state of a baseline."""
    return rows.where(is_child()), rows.where(is_entity())


def staged(rows: DataFrame) -> DataFrame:
    """Both states of a baseline in one pass over the rows, with the column ``level``: ``child`` or
    ``entity``. A row that passes both rules is there twice."""
    child, entity = F.when(is_child(), F.lit("child")), F.when(is_entity(), F.lit("entity"))
    return rows.withColumn("level", F.explode(F.array_compact(F.array(child, entity))))
