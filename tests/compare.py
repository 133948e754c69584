"""Rows of a query held against those of its SQL, value by value."""

import glob
import math
import os
from collections import Counter

import duckdb


def plain(v):
    """A value in the form both sides share: numbers to four places, everything else as text."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "item") or type(v).__name__ == "Decimal":
        return round(float(v), 4)
    return str(v)


def differences(spark, query, sql, folder):
    """(rows only in Spark, rows only in SQL), at most three each, and the number of rows."""
    df = query(spark, folder)
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    place = [rel.columns.index(c) for c in df.columns]
    mine = Counter(tuple(plain(v) for v in r) for r in df.collect())
    theirs = Counter(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    return list((mine - theirs))[:3], list((theirs - mine))[:3], sum(mine.values())
