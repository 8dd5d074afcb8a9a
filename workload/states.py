"""Two states per data set, derived from the given tables.

``k % 20`` of a row's number decides: 0 only current, 1 only previous, 2 changed payload,
3 new name, else unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftmark.operators.fingerprints import fp_rows


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _price(side: str, b: str, price: str) -> str:
    if side == "previous":
        return price
    return f"CASE WHEN {b} = 2 THEN cast({price} + 1 as decimal(18,2)) ELSE {price} END"


def _name(side: str, b: str, name: str) -> str:
    return f"concat({name}, CASE WHEN {b} = 3 THEN '_new' ELSE '' END)" if side == "current" else name


def _present(side: str, b: str) -> str:
    return f"{b} <> {1 if side == 'current' else 0}"


def orders_state(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Child rows with unique keys."""
    b = "o_orderkey % 20"
    price = _price(side, b, "cast(o_totalprice as decimal(18,2))")
    keys = {
        "schema_name": F.col("o_orderstatus"),
        "object_type": "Table",
        "object_type_name": F.expr("concat('cust_', o_custkey)"),
        "object_subtype": "Column",
        "object_subtype_name": F.expr(_name(side, b, "concat('order_', o_orderkey)")),
    }
    details = f"concat('price:', {price}, ',prio:', o_orderpriority, ',ordinal_position:', o_orderkey)"
    return fp_rows(table(spark, sf, "orders").where(_present(side, b)), keys, F.expr(details))


def lineitem_state(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Child rows with repeated keys. Rows are made distinct while they are still numbers: the
    shuffle is narrow and the text is built after it. Their case is aggregated with them, so that no
    filter on it gets below: both states then read one and the same exchange."""
    b = "b"
    columns = {
        "l_returnflag": "l_returnflag",
        "l_orderkey": "l_orderkey",
        "l_linenumber": "l_linenumber",
        "qty": "cast(l_quantity as decimal(18,2))",
        "price": "cast(l_extendedprice as decimal(18,2))",
    }
    rows = (
        table(spark, sf, "lineitem")
        .selectExpr(*[f"{e} as {c}" for c, e in columns.items()])
        .groupBy(*columns)
        .agg(F.expr("cast(max((l_orderkey * 7 + l_linenumber) % 20) as int) as b"))
        .where(_present(side, b))
    )
    keys = {
        "schema_name": F.col("l_returnflag"),
        "object_type": "Table",
        "object_type_name": F.expr("concat('order_', l_orderkey)"),
        "object_subtype": "Column",
        "object_subtype_name": F.expr(_name(side, b, "concat('line_', l_linenumber)")),
    }
    details = f"concat('qty:', qty, ',price:', {_price(side, b, 'price')}, ',ordinal_position:', l_linenumber)"
    return fp_rows(rows, keys, F.expr(details))


def part_state(spark: SparkSession, sf: str, side: str) -> DataFrame:
    """Entity rows whose MD5s collide within a brand and type."""
    b = "p_partkey % 20"
    size = f"CASE WHEN {b} = 2 THEN p_size + 100 ELSE p_size END" if side == "current" else "p_size"
    keys = {
        "schema_name": F.col("p_brand"),
        "object_type": F.col("p_type"),
        "object_type_name": F.expr(_name(side, b, "concat(p_name, '#', p_partkey)")),
    }
    rows = table(spark, sf, "part").where(_present(side, b))
    return fp_rows(rows, keys, F.expr(f"concat('size:', {size})"))


def both(state, spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return state(spark, sf, "current"), state(spark, sf, "previous")
