"""Small frames, and a pair-by-pair reading of the difference to test the counted one against."""

from __future__ import annotations

from collections import Counter

from driftmark.schemas import CHILD_KEYS, ENTITY_KEYS, FINGERPRINT_SCHEMA


def child(spark, rows):
    """Rows ``(schema, table, subtype, name, md5)``; the details repeat the MD5."""
    return spark.createDataFrame(
        [(s, "Table", t, st, n, f"d:{m}", m) for s, t, st, n, m in rows], FINGERPRINT_SCHEMA
    )


def entity(spark, rows):
    """Rows ``(schema, type, name, md5)``."""
    return spark.createDataFrame([(s, t, n, None, None, f"d:{m}", m) for s, t, n, m in rows], FINGERPRINT_SCHEMA)


def log_rows(df):
    """Change rows as a multiset of (change, name column values, md5)."""
    out = Counter()
    for r in df.collect():
        key = tuple(r[k] for k in CHILD_KEYS)
        out[(r.change_type, key, r.object_md5)] += r.copies
    return out


def _same(a, b, columns):
    return all(a[c] is not None and a[c] == b[c] for c in columns)


def _differ(a, b):
    """Both have an MD5, and it isn't the same: a missing one is neither equal nor unequal."""
    return None not in (a.object_md5, b.object_md5) and a.object_md5 != b.object_md5


def brute_child(current, previous):
    cur, prev = current.collect(), previous.collect()
    out, processed = Counter(), []
    for c in cur:
        for s in prev:
            names = (c.object_subtype_name, s.object_subtype_name)
            if _same(c, s, (*CHILD_KEYS[:4], "object_md5")) and None not in names and names[0] != names[1]:
                out[("RENAMED", tuple(c[k] for k in CHILD_KEYS), c.object_md5)] += 1
                processed.append(c)
            if _same(c, s, CHILD_KEYS) and _differ(c, s):
                out[("MODIFIED", tuple(c[k] for k in CHILD_KEYS), c.object_md5)] += 1
                processed.append(c)
    for change, rows, others in (("ADDED", cur, prev), ("DELETED", prev, cur)):
        for r in rows:
            if not any(_same(r, o, CHILD_KEYS) for o in others) and not any(_same(r, p, CHILD_KEYS) for p in processed):
                out[(change, tuple(r[k] for k in CHILD_KEYS), r.object_md5)] += 1
    return out


def brute_entity(current, previous):
    cur, prev = current.collect(), previous.collect()
    by_md5, by_name = (*ENTITY_KEYS[:2], "object_md5"), ENTITY_KEYS

    def count(rows, r, columns):
        return sum(_same(r, o, columns) for o in rows)

    out, processed = Counter(), []

    def key(r):
        return tuple(r[k] for k in CHILD_KEYS)

    for c in cur:
        for s in prev:
            if (
                _same(c, s, by_md5)
                and c.object_type_name != s.object_type_name
                and count(cur, c, by_md5) == 1
                and count(prev, s, by_md5) == 1
                and not any(_same(c, o, (*ENTITY_KEYS, "object_md5")) for o in prev)
            ):
                out[("RENAMED", key(c), c.object_md5)] += 1
                processed += [c, s]
            if (
                _same(c, s, by_name)
                and _differ(c, s)
                and count(cur, c, by_name) == 1
                and count(prev, s, by_name) == 1
            ):
                out[("MODIFIED", key(c), c.object_md5)] += 1
                processed.append(c)
    for change, rows, others in (("ADDED", cur, prev), ("DELETED", prev, cur)):
        for r in rows:
            if not any(_same(r, o, by_name) for o in others) and not any(_same(r, p, by_name) for p in processed):
                out[(change, key(r), r.object_md5)] += 1
    return out
