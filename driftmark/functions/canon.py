"""Column expressions that build canonical text, the input of every fingerprint.

A column given by name takes one SQL expression, which keeps building wide rows cheap on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: ColumnOrName) -> Column:
    """Text form, NULL as the empty string."""
    if isinstance(c, str):
        return F.expr(f"coalesce(cast({c} as string), '')")
    return F.coalesce(c.cast("string"), F.lit(""))


def kv(label: str, c: ColumnOrName) -> Column:
    """``label:value``; a NULL value leaves ``label:``."""
    if isinstance(c, str):
        return F.expr(f"concat('{label}:', coalesce(cast({c} as string), ''))")
    return F.concat(F.lit(f"{label}:"), text(c))


def kv_if_set(label: str, c: ColumnOrName) -> Column:
    """``label:value``, or NULL for a NULL value so that :func:`joined` drops the whole part."""
    if isinstance(c, str):
        return F.expr(f"concat('{label}:', cast({c} as string))")
    return F.concat(F.lit(f"{label}:"), c.cast("string"))


def joined(parts: Iterable[ColumnOrName], sep: str) -> Column:
    """Parts with ``sep`` between; NULL parts leave no trace."""
    return F.concat_ws(sep, *parts)


def collapse_ws(c: ColumnOrName) -> Column:
    """Each run of whitespace becomes one blank."""
    return F.regexp_replace(col(c), r"\s+", " ")


def tighten_parens(c: ColumnOrName) -> Column:
    """No blank after an opening or before a closing parenthesis."""
    return F.regexp_replace(F.regexp_replace(col(c), r"\(\s+", "("), r"\s+\)", ")")


def sorted_list(item: str, sep: str, *, distinct: bool = False, by: str | None = None) -> Column:
    """Aggregate ``item`` to one text, in binary text order or in the order of ``by``."""
    head = "distinct " if distinct else ""
    return F.expr(f"listagg({head}{item}, '{sep}') within group (order by {by or item})")


def preview(c: ColumnOrName, limit: int = 90) -> Column:
    """Text cut to ``limit`` characters, ``...`` marking a cut."""
    c = col(c)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def fmt_time(c: ColumnOrName) -> Column:
    """``YYYY-MM-DD HH:MM:SS.cc``: hundredths are cut, not rounded; NULL shows as nothing."""
    return F.coalesce(F.date_format(col(c), "yyyy-MM-dd HH:mm:ss.SS"), F.lit(""))


def bare_name(c: ColumnOrName) -> Column:
    """A routine name without its argument list."""
    return F.coalesce(F.substring_index(col(c), "(", 1), F.lit(""))
