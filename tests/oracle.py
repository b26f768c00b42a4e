"""Runs a query in Spark and its oracle in DuckDB, and compares the rows."""

import math

import duckdb
import pyarrow as pa

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, int, float)):
        return v
    return str(v)


def kind(t):
    """What kind of values a column has: schemas have to agree in it."""
    for name in ("integer", "floating", "boolean", "decimal", "temporal", "nested"):
        if getattr(pa.types, f"is_{name}")(t):
            return name
    return "text"


def rows(table):
    cols = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in cols]
    return cols, sorted((tuple(map(plain, r)) for r in zip(*data, strict=True)), key=repr)


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    expected = con.sql(sql).to_arrow_table()
    got = query(spark, sf_dir).toArrow()
    assert {f.name: kind(f.type) for f in got.schema} == {f.name: kind(f.type) for f in expected.schema}, name
    assert rows(got) == rows(expected), name
