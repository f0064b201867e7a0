"""A query against its DuckDB twin, as sorted rows."""

import glob
import os

import duckdb


def _plain(value):
    return round(value, 6) if isinstance(value, float) else value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def duck_rows(sql, sf):
    with duckdb.connect() as con:
        for path in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        order = sorted(range(len(names)), key=lambda i: names[i])
        return sorted(names), sorted((tuple(_plain(r[i]) for i in order) for r in found.fetchall()), key=repr)
