"""Runs a registered query beside its SQL in DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, decimal.Decimal)):
        return round(float(v), 6) if isinstance(v, decimal.Decimal) and v % 1 else int(v)
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=repr)


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def compare(df, con, sql: str) -> str:
    """Empty if both sides agree, else what differs."""
    got = df.collect()
    names, mine = rows_of(df.columns, got)
    cur = con.execute(sql)
    other_names, other = rows_of([c[0] for c in cur.description], cur.fetchall())
    if names != other_names:
        return f"columns {names} and {other_names}"
    if len(mine) != len(other):
        extra = [x for x in mine if x not in set(other)][:2]
        return f"{len(mine)} and {len(other)} rows; only here {extra!r:.600}; only there {[x for x in other if x not in set(mine)][:2]!r:.600}"
    bad = [(a, b) for a, b in zip(mine, other) if a != b]
    return f"{len(bad)} of {len(mine)} rows differ, first {bad[0]!r:.1500}" if bad else ""


