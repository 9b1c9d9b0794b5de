"""Rows of Spark and DuckDB, made comparable."""

import math


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def rows(columns, values):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in values)
