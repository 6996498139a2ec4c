"""Compare a query with its SQL as the gate does: same columns, same multiset of values."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pandas as pd


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    return pd.DataFrame(cursor.fetchall(), columns=names, dtype=object)


def _plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    try:
        return float(v) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(columns: list[str], data) -> Counter:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return Counter(tuple(_plain(r[k]) for k in order) for r in data)


def difference(df, sf_dir: str, sql: str) -> str:
    """Empty when both agree, else what differs."""
    want = oracle(sf_dir, sql)
    if sorted(df.columns) != sorted(want.columns):
        return f"columns {sorted(df.columns)} and {sorted(want.columns)}"
    a, b = rows(df.columns, df.collect()), rows(list(want.columns), want.itertuples(index=False, name=None))
    if a == b:
        return ""
    more, less = list((a - b).items())[:3], list((b - a).items())[:3]
    return f"{sum(a.values())} and {sum(b.values())} rows; only here {more}; only there {less}"
