"""Compare a query with its SQL in DuckDB."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(v):
        return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (int, bool)) else str(v)

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=lambda r: [str(x) for x in r])


def both(spark, queries, oracles, name, sf_dir=SF):
    df = queries[name](spark, sf_dir)
    found = connect(sf_dir).execute(oracles[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    return plain([tuple(r) for r in df.collect()], df.columns), plain(found.fetchall(), names)
