"""A query beside its SQL, as the driver compares them."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    norm = lambda row: tuple(round(v, 9) if isinstance(v, float) else v for v in row)
    key = lambda row: tuple((v is not None, str(v)) for v in row)
    left = sorted((norm(tuple(r)) for r in df.select(*cols).collect()), key=key)
    right = sorted(map(norm, con.sql(f"select {', '.join(cols)} from ({sql})").fetchall()), key=key)
    assert sorted(con.sql(sql).columns) == cols
    assert left == right
    return len(left)
