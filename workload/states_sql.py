"""SQL of the derived states and of their differences."""

from __future__ import annotations

CHILD = ("schema_name", "object_type", "object_type_name", "object_subtype", "object_subtype_name")
ENTITY = CHILD[:3]
ROW = ", ".join((*CHILD, "object_subtype_details", "object_md5"))


def orders_sql(side: str) -> str:
    cur = side == "current"
    price = "o_totalprice::DECIMAL(18,2)"
    changed = f"CASE WHEN o_orderkey % 20 = 2 THEN ({price} + 1)::DECIMAL(18,2) ELSE {price} END"
    suffix = "CASE WHEN o_orderkey % 20 = 3 THEN '_new' ELSE '' END" if cur else "''"
    return f"""
        SELECT *, md5(object_subtype_details) AS object_md5 FROM (
            SELECT o_orderstatus AS schema_name, 'Table' AS object_type, 'cust_' || o_custkey AS object_type_name,
                   'Column' AS object_subtype, 'order_' || o_orderkey || {suffix} AS object_subtype_name,
                   'price:' || ({changed if cur else price})::VARCHAR || ',prio:' || o_orderpriority
                     || ',ordinal_position:' || o_orderkey AS object_subtype_details
            FROM orders WHERE o_orderkey % 20 <> {1 if cur else 0})"""


def lineitem_sql(side: str) -> str:
    cur = side == "current"
    b = "(l_orderkey * 7 + l_linenumber) % 20"
    price = "l_extendedprice::DECIMAL(18,2)"
    changed = f"CASE WHEN {b} = 2 THEN ({price} + 1)::DECIMAL(18,2) ELSE {price} END"
    suffix = f"CASE WHEN {b} = 3 THEN '_new' ELSE '' END" if cur else "''"
    return f"""
        SELECT DISTINCT *, md5(object_subtype_details) AS object_md5 FROM (
            SELECT l_returnflag AS schema_name, 'Table' AS object_type, 'order_' || l_orderkey AS object_type_name,
                   'Column' AS object_subtype, 'line_' || l_linenumber || {suffix} AS object_subtype_name,
                   'qty:' || l_quantity::DECIMAL(18,2)::VARCHAR || ',price:' || ({changed if cur else price})::VARCHAR
                     || ',ordinal_position:' || l_linenumber AS object_subtype_details
            FROM lineitem WHERE {b} <> {1 if cur else 0})"""


def part_sql(side: str) -> str:
    cur = side == "current"
    size = "CASE WHEN p_partkey % 20 = 2 THEN p_size + 100 ELSE p_size END" if cur else "p_size"
    suffix = "CASE WHEN p_partkey % 20 = 3 THEN '_new' ELSE '' END" if cur else "''"
    return f"""
        SELECT *, md5(object_subtype_details) AS object_md5 FROM (
            SELECT p_brand AS schema_name, p_type AS object_type,
                   p_name || '#' || p_partkey || {suffix} AS object_type_name,
                   NULL::VARCHAR AS object_subtype, NULL::VARCHAR AS object_subtype_name,
                   'size:' || ({size}) AS object_subtype_details
            FROM part WHERE p_partkey % 20 <> {1 if cur else 0})"""


def two(state, p: str = "") -> dict[str, str]:
    """Named queries ``<p>cur`` and ``<p>prev`` of a state."""
    return {f"{p}cur": state("current"), f"{p}prev": state("previous")}


def _same(keys: tuple[str, ...], a: str, b: str) -> str:
    return " AND ".join(f"{a}.{k} = {b}.{k}" for k in keys)


def _missing(keys: tuple[str, ...], a: str, table: str) -> str:
    return f"NOT EXISTS (SELECT 1 FROM {table} z WHERE {_same(keys, 'z', a)})"


def child_diff_sql(p: str = "") -> dict[str, str]:
    """Named queries of the child difference of ``<p>cur`` and ``<p>prev``, a row per pair."""
    keys = ", ".join(CHILD)
    return {
        f"{p}renamed": f"""SELECT c.*, 'RENAMED' AS change_type FROM {p}cur c JOIN {p}prev s
            ON {_same((*CHILD[:4], "object_md5"), "c", "s")}
           AND c.object_subtype_name <> s.object_subtype_name""",
        f"{p}modified": f"""SELECT c.*, 'MODIFIED' AS change_type FROM {p}cur c JOIN {p}prev s
            ON {_same(CHILD, "c", "s")} WHERE c.object_md5 <> s.object_md5""",
        f"{p}processed": f"SELECT {keys} FROM {p}renamed UNION SELECT {keys} FROM {p}modified",
        f"{p}added": f"""SELECT c.*, 'ADDED' AS change_type FROM {p}cur c
            WHERE {_missing(CHILD, "c", p + "prev")} AND {_missing(CHILD, "c", p + "processed")}""",
        f"{p}deleted": f"""SELECT s.*, 'DELETED' AS change_type FROM {p}prev s
            WHERE {_missing(CHILD, "s", p + "cur")} AND {_missing(CHILD, "s", p + "processed")}""",
        f"{p}pairs": " UNION ALL ".join(
            f"SELECT {ROW}, change_type FROM {p}{c}" for c in ("renamed", "modified", "added", "deleted")
        ),
        f"{p}changes": f"SELECT {ROW}, change_type, count(*) AS copies FROM {p}pairs GROUP BY ALL",
    }


def entity_diff_sql(p: str = "") -> dict[str, str]:
    """Named queries of the collision-safe entity difference."""
    by_md5, by_name = ("schema_name", "object_type", "object_md5"), ENTITY
    md5_list, name_list = ", ".join(by_md5), ", ".join(by_name)

    def counted(side: str) -> str:
        return f"""SELECT t.*, m.cnt AS md5_count, n.cnt AS name_count FROM {p}{side} t
            LEFT JOIN (SELECT {md5_list}, count(*) AS cnt FROM {p}{side} GROUP BY {md5_list}) m
              ON {_same(by_md5, "m", "t")}
            LEFT JOIN (SELECT {name_list}, count(*) AS cnt FROM {p}{side} GROUP BY {name_list}) n
              ON {_same(by_name, "n", "t")}"""

    return {
        f"{p}ccur": counted("cur"),
        f"{p}cprev": counted("prev"),
        f"{p}renamed": f"""SELECT c.*, 'RENAMED' AS change_type, s.object_type_name AS prev_object_type_name
            FROM {p}ccur c JOIN {p}cprev s ON {_same(by_md5, "c", "s")} AND c.object_type_name <> s.object_type_name
            WHERE c.md5_count = 1 AND s.md5_count = 1
              AND {_missing((*ENTITY, "object_md5"), "c", p + "prev")}""",
        f"{p}modified": f"""SELECT c.*, 'MODIFIED' AS change_type, c.object_type_name AS prev_object_type_name
            FROM {p}ccur c JOIN {p}cprev s ON {_same(ENTITY, "c", "s")}
            WHERE c.object_md5 <> s.object_md5 AND c.name_count = 1 AND s.name_count = 1""",
        f"{p}processed": f"""SELECT {name_list} FROM {p}renamed
            UNION SELECT schema_name, object_type, prev_object_type_name FROM {p}renamed
            UNION SELECT {name_list} FROM {p}modified""",
        f"{p}added": f"""SELECT c.*, 'ADDED' AS change_type, NULL AS prev_object_type_name FROM {p}cur c
            WHERE {_missing(ENTITY, "c", p + "prev")} AND {_missing(ENTITY, "c", p + "processed")}""",
        f"{p}deleted": f"""SELECT s.*, 'DELETED' AS change_type, s.object_type_name AS prev_object_type_name
            FROM {p}prev s
            WHERE {_missing(ENTITY, "s", p + "cur")} AND {_missing(ENTITY, "s", p + "processed")}""",
        f"{p}changes": " UNION ALL ".join(
            f"SELECT {ROW}, change_type, 1 AS copies, prev_object_type_name FROM {p}{c}"
            for c in ("renamed", "modified", "added", "deleted")
        ),
    }
