"""Spark rows beside DuckDB rows."""

import glob
import math
import os


def plain(rows, columns):
    def value(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 9)
        return x

    return sorted((tuple(value(r[c]) for c in sorted(columns)) for r in rows), key=repr)


def spark_rows(df):
    return plain([r.asDict() for r in df.collect()], df.columns)


def duck_rows(sql, folder=None, frames=None):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet") if folder else []:
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, frame in (frames or {}).items():
        con.register(name, frame)
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return plain([dict(zip(columns, r, strict=True)) for r in got.fetchall()], columns)
