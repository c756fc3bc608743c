"""Order-free comparison of two results by column name and value."""

import numpy as np
import pandas as pd


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float | np.floating):
        return None if v != v else int(v) if v == int(v) and abs(v) < 1e15 else round(float(v), 6)
    if isinstance(v, bool | np.bool_):
        return bool(v)
    if isinstance(v, np.integer):
        return int(v)
    if isinstance(v, list | tuple | np.ndarray):
        return tuple(plain(x) for x in v)
    return v


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(map(repr, (tuple(plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False))))


def same(ours, theirs):
    a, b = rows(ours), rows(theirs)
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1], next((x, y) for x, y in zip(a[1], b[1], strict=True) if x != y)
