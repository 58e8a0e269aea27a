"""Rows of a query and of its SQL, in one form."""

import os

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def there() -> bool:
    try:
        import duckdb  # noqa: F401
    except ImportError:
        return False
    return os.path.isdir(SF)


def rows(got, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else int(v) if isinstance(v, bool) else v
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in got), key=str)


def same(spark, query, con, sql):
    df, want = query(spark, SF), con.sql(sql)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), list(want.columns))
