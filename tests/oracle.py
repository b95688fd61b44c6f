"""Run a query on Spark and its oracle on DuckDB and compare rows, columns by name."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _row(values):
    return tuple(("%.9g" % v if not math.isnan(v) else "nan") if isinstance(v, float) else str(v) for v in values)


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if os.path.isdir(p) else ''}')")
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(_row(r[i] for i in order) for r in rel.fetchall())


def actual(df):
    names = sorted(df.columns)
    return names, sorted(_row(r) for r in df.select(*[f"`{n}`" for n in names]).collect())
