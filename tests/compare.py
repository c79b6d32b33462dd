"""A query's rows against its SQL's, as multisets of values by column name."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return v


def differences(spark_df, con, sql):
    got_columns = sorted(spark_df.columns)
    rel = con.sql(sql)
    if got_columns != sorted(rel.columns):
        return f"columns {got_columns} and {sorted(rel.columns)}"
    want = rel.fetchall()
    order = [rel.columns.index(c) for c in got_columns]
    key = lambda row: tuple((v is not None, str(type(v).__name__ == "str"), str(v)) for v in row)
    want = sorted((tuple(_plain(r[i]) for i in order) for r in want), key=key)
    got = sorted((tuple(_plain(v) for v in r) for r in spark_df.select(got_columns).collect()), key=key)
    if got != want:
        bad = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"{len(got)} and {len(want)} rows; first difference {bad}"
    return None
