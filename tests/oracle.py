"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(x):
    if hasattr(x, "tolist"):
        x = x.tolist()
    if x is None or str(x) in ("nan", "<NA>", "NaT", "None"):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 9) + 0.0
    return [plain(y) for y in x] if isinstance(x, list) else str(x)


def rows(frame, names):
    return sorted(str([plain(x) for x in r]) for r in frame[names].itertuples(index=False, name=None))


def connect(sf_dir=SF):
    con = duckdb.connect()
    for f in os.listdir(sf_dir):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def same(spark, query, sql, con, sf_dir=SF):
    got, want = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    a, b = rows(got, names), rows(want, names)
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, (names, wrong[:3])
    return len(a)
