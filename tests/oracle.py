"""Running a registered query and its SQL on one folder of tables, and comparing the rows."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata/sf0.001")


def connect(folder: Path):
    con = duckdb.connect()
    for file in folder.glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, query, sql):
    df = query(spark, str(DATA))
    got = rows_of(df.columns, df.collect())
    answer = con.execute(sql)
    assert got == rows_of([c[0] for c in answer.description], answer.fetchall())
