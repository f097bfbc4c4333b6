"""Run a registered query beside its SQL and compare the rows."""

import datetime
import glob
import math

import duckdb


def normal(v):
    if isinstance(v, float):
        return ("f", "nan" if math.isnan(v) else round(v, 9) + 0.0)
    if isinstance(v, (datetime.date, datetime.datetime)):
        return ("d", v.isoformat())
    return (type(v).__name__, v) if not isinstance(v, (list, tuple)) else ("l", tuple(map(normal, v)))


def compare(spark, name, f, sql, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(sql)
    names, want = [d[0] for d in cur.description], cur.fetchall()
    df = f(spark, sf)
    assert sorted(df.columns) == sorted(names), (name, df.columns, names)
    got = df.select(*sorted(names)).collect()
    order = [names.index(n) for n in sorted(names)]
    key = lambda rows: sorted((tuple(normal(v) for v in r) for r in rows), key=repr)
    a, b = key(got), key([tuple(r[i] for i in order) for r in want])
    assert len(a) == len(b), (name, len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not bad, (name, len(bad), bad[:2])
    return len(a)
