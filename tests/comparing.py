"""Rows of a query against those of SQL that DuckDB runs over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same_rows(frame, sql, sf_dir):
    got = frame.toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    rows = lambda d: sorted((tuple(r) for r in d[columns].astype(object).where(d[columns].notna(), None).values.tolist()), key=repr)
    assert rows(got) == rows(want)
