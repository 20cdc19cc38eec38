"""Runs registered queries beside their DuckDB texts on the smallest test tables."""

from collections import Counter
from pathlib import Path

import duckdb

from tools.compare import plain

FOLDER = Path("/root/testdata/sf0.001")


def database():
    db = duckdb.connect()
    db.sql("set timezone='UTC'")
    for p in sorted(FOLDER.glob("*.parquet")):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    return db


def same(spark, db, query, sql):
    df = query(spark, str(FOLDER))
    cols = sorted(df.columns)
    mine = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    rel = db.sql(sql)
    assert sorted(rel.columns) == cols
    order = [rel.columns.index(c) for c in cols]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in rel.fetchall())
    assert mine == theirs, (list((mine - theirs).items())[:2], list((theirs - mine).items())[:2])
