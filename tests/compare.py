"""Rows of a Spark query and of its SQL, made comparable."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return datetime(x.year, x.month, x.day).isoformat()
    if isinstance(x, list | tuple):
        return tuple(plain(y) for y in x)
    if type(x).__name__ == "Decimal":
        return round(float(x), 5) + 0.0
    return float(x) if isinstance(x, int) else x


def difference(df, con, sql: str) -> str:
    """What is unlike: empty if nothing. Numbers count as equal within 2e-5."""
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = cur.fetchall()
    have = df.collect()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(have) != len(want):
        return f"{len(have)} and {len(want)} rows"
    order = sorted(names)
    left = [tuple(plain(r[c]) for c in order) for r in have]
    at = [names.index(c) for c in order]
    right = [tuple(plain(r[i]) for i in at) for r in want]
    if Counter(left) == Counter(right):
        return ""
    bad = []
    for a, b in _paired(left, right):
        for c, x, y in zip(order, a, b, strict=True):
            close = x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1.0, abs(x)))
            if not close:
                bad.append((c, x, y, a, b))
    return f"{len(bad)} values, such as {bad[0]}" if bad else ""


def _paired(left: list[tuple], right: list[tuple]):
    """Rows in the order of their texts and missing values, then of their numbers."""

    def key(t):
        return [(0, "") if x is None else (1, x) if isinstance(x, str) else (2, str(x)) if isinstance(x, bool) else (3, "") for x in t], [x if isinstance(x, float) else 0.0 for x in t]

    return zip(sorted(left, key=key), sorted(right, key=key), strict=True)
