"""Runs a catalogue query and its SQL twin on the same files and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    if hasattr(v, "isoformat"):
        return v.isoformat()[:26].replace("+00:00", "")
    return str(v)


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def compare(spark, name, sf_dir, query, sql):
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    theirs = rows_of(cols, cur.fetchall())
    assert sorted(df.columns) == sorted(cols), (name, df.columns, cols)
    assert len(ours) == len(theirs), (name, len(ours), len(theirs), sorted(set(ours) - set(theirs))[:3], sorted(set(theirs) - set(ours))[:3])
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    assert not bad, (name, len(bad), bad[:3])
    return len(ours)
