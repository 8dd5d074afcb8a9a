"""Codes of the source catalog turned into the labels that reports and fingerprints show."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftmark.functions.canon import ColumnOrName, col, collapse_ws

# Labels that end up inside fingerprints, so they have to stay as they are.
RELATION_KINDS = {"r": "Table", "v": "View", "m": "Materialized View"}

TYPE_NAMES = {
    "varchar": "character varying",
    "bpchar": "character",
    "int4": "integer",
    "int8": "bigint",
    "int2": "smallint",
    "float4": "real",
    "float8": "double precision",
    "bool": "boolean",
    "timestamptz": "timestamp with time zone",
    "timestamp": "timestamp without time zone",
    "timetz": "time with time zone",
    "time": "time without time zone",
}

FIXED_PRECISION = {"int2": 16, "int4": 32, "int8": 64, "float4": 24, "float8": 53}

CONSTRAINT_KINDS = {"p": "PRIMARY KEY", "u": "UNIQUE", "c": "CHECK", "f": "FOREIGN KEY"}

VOLATILITY = {"i": "IMMUTABLE", "s": "STABLE", "v": "VOLATILE"}

PARALLEL = {"s": "SAFE", "r": "RESTRICTED", "u": "UNSAFE"}

OWNERSHIP = {"i": "IDENTITY", "a": "SERIAL"}

# SQL keywords that need quotes as identifiers (PostgreSQL manual, appendix C).
QUOTED_KEYWORDS = (
    "all analyse analyze and any array as asc asymmetric authorization between bigint binary bit "
    "boolean both case cast char character check coalesce collate collation column concurrently "
    "constraint create cross current_catalog current_date current_role current_schema "
    "current_time current_timestamp current_user dec decimal default deferrable desc distinct do "
    "else end except exists extract false fetch float for foreign freeze from full grant greatest "
    "group grouping having ilike in initially inner inout int integer intersect interval into is "
    "isnull join json json_array json_arrayagg json_object json_objectagg lateral leading least "
    "left like limit localtime localtimestamp national natural nchar none normalize not notnull "
    "null nullif numeric offset on only or order out outer overlaps overlay placing position "
    "precision primary real references returning right row select session_user setof similar "
    "smallint some substring symmetric system_user table tablesample then time timestamp to "
    "trailing treat trim true union unique user using values varchar variadic verbose when where "
    "window with xmlattributes xmlconcat xmlelement xmlexists xmlforest xmlnamespaces xmlparse "
    "xmlpi xmlroot xmlserialize xmltable"
).split()


def label(c: str, names: Mapping[str, object], default: str = "NULL") -> Column:
    """The entry of ``names`` for a code, else the SQL expression ``default``."""
    cases = " ".join(f"WHEN '{code}' THEN {name!r}" for code, name in names.items())
    return F.expr(f"CASE {c} {cases} ELSE {default} END")


def type_name(typname: str) -> Column:
    return label(typname, TYPE_NAMES, typname)


def type_length(typname: str, typmod: str) -> Column:
    """Declared length of a character type; an unset modifier (-1) gives -5."""
    return F.expr(f"CASE WHEN {typname} IN ('varchar', 'bpchar') THEN {typmod} - 4 END")


def numeric_precision(typname: str, typmod: str) -> Column:
    """Upper half of a numeric modifier, or the width of a fixed-size number."""
    packed = F.expr(f"shiftright({typmod} - 4, 16) & 65535")
    return F.when(F.col(typname) == "numeric", packed).otherwise(label(typname, FIXED_PRECISION))


def numeric_scale(typname: str, typmod: str) -> Column:
    """Lower half of a numeric modifier; other numbers have scale 0."""
    numbers = ", ".join(f"'{t}'" for t in FIXED_PRECISION)
    return F.expr(
        f"CASE WHEN {typname} = 'numeric' THEN ({typmod} - 4) & 65535 WHEN {typname} IN ({numbers}) THEN 0 END"
    )


def quoted_ident(c: ColumnOrName) -> Column:
    """An identifier as SQL text, in quotes when it needs them."""
    c = col(c)
    plain = c.rlike(r"\A[a-z_][a-z0-9_]*\z") & ~c.isin(QUOTED_KEYWORDS)
    return F.when(plain, c).otherwise(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')))


def has_bit(c: str, bit: int) -> Column:
    return F.expr(f"(cast({c} as int) & {bit}) = {bit}")


def _first_bit(c: str, names: Mapping[int, str], default: str) -> Column:
    cases = " ".join(f"WHEN (cast({c} as int) & {bit}) = {bit} THEN '{name}'" for bit, name in names.items())
    return F.expr(f"CASE {cases} ELSE {default} END")


def trigger_timing(tgtype: str, *, corrected: bool = False) -> Column:
    """Timing label. The default reads bits 4/8/16, which stored fingerprints depend on;
    ``corrected`` reads the bits the server sets (2 before, 64 instead of, else after)."""
    if corrected:
        return _first_bit(tgtype, {64: "INSTEAD OF", 2: "BEFORE"}, "'AFTER'")
    return _first_bit(tgtype, {4: "BEFORE", 8: "AFTER", 16: "INSTEAD OF"}, "NULL")


def trigger_event(tgtype: str, *, corrected: bool = False) -> Column:
    """First matching event. The default reads bits 2/4/8, ``corrected`` the server's 4/8/16/32."""
    names = (
        {4: "INSERT", 8: "DELETE", 16: "UPDATE", 32: "TRUNCATE"}
        if corrected
        else {2: "INSERT", 4: "DELETE", 8: "UPDATE"}
    )
    return _first_bit(tgtype, names, "'UNKNOWN'")


def trigger_level(tgtype: str) -> Column:
    return _first_bit(tgtype, {1: "ROW"}, "'STATEMENT'")


# The shape of a procedural body that is kept, and of its closing RETURN. Dot
# matches line ends, case is ignored, \z is the end of the text.
_BODY = r"(?si).*?(DECLARE|BEGIN)(.*?)END;?\s*\$[^$]*\$.*\z"
_LAST_RETURN = r"(?si)\s*RETURN\s+[^;]+;?\s*\z"


def routine_body(language: ColumnOrName, source: ColumnOrName, definition: ColumnOrName) -> Column:
    """Body text that is hashed: whitespace-folded source for SQL routines, the block between
    its first keyword and END without a last RETURN for procedural ones, else trimmed source."""
    block = F.regexp_replace(col(definition), _BODY, "$1$2")
    block = F.regexp_replace(block, _LAST_RETURN, "")
    return (
        F.when(col(language) == "sql", collapse_ws(F.trim(col(source))))
        .when(col(language) == "plpgsql", collapse_ws(block))
        .otherwise(F.trim(col(source)))
    )
