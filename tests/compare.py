"""Order-free comparison of two results."""

import math


def cell(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ in ("Decimal", "int64", "int32", "float64", "float32"):
        f = float(v)
        return f"{0.0 if f == 0 else f:.8g}" if math.isfinite(f) else str(f)
    return str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in data)


def same(df, relation):
    got = df.collect()
    assert sorted(df.columns) == sorted(relation.columns)
    a, b = rows(df.columns, got), rows(relation.columns, relation.fetchall())
    assert len(a) == len(b), (len(a), len(b))
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]
    return len(a)
