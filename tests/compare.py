"""Compare a Spark result with DuckDB's, the way a checker would: by sorted columns and rows."""

from __future__ import annotations

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(0.0 if v == 0 else v)
    return f"{type(v).__name__}:{v}"


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def spark_rows(df):
    return normalise(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return normalise([d[0] for d in cur.description], cur.fetchall())


def difference(df, con, sql, shown=3):
    got_cols, got = spark_rows(df)
    want_cols, want = duck_rows(con, sql)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}", len(got)
    if got != want:
        extra, missing = sorted(set(got) - set(want)), sorted(set(want) - set(got))
        return (f"{len(got)} rows vs {len(want)}; {len(extra)} only in Spark, {len(missing)} only in SQL\n"
                f"  spark {extra[:shown]}\n  sql   {missing[:shown]}"), len(got)
    return None, len(got)
