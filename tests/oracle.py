"""A Spark result and DuckDB's answer to the same question, compared as multisets of rows."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql: str, sf_dir: str = SF) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as con:
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        found = con.execute(sql)
        return [d[0] for d in found.description], found.fetchall()


def _value(v):
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows(names: list[str], found: list) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_value(r[i]) for i in order) for r in found), key=repr)


def assert_same(df, sql: str, sf_dir: str = SF) -> None:
    names, want = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want)
