"""Every registered click query against DuckDB over the same tables."""

import math
from pathlib import Path

import duckdb
import pytest

from clickloom.plans.oracles import oracles
from clickloom.plans.queries import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{round(v + 0.0, 5):.5f}".replace("-0.00000", "0.00000")
    return str(v)


def sort_rows(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_agrees_with_duckdb(spark, con, name):
    got = queries()[name](spark, SF)
    want = con.execute(oracles()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sort_rows(got.collect(), got.columns) == sort_rows(want.fetchall(), columns)


def test_every_oracle_has_a_query():
    assert set(oracles()) <= set(queries())


def test_queries_without_oracle_give_a_row_per_visitor(spark):
    n = spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()
    assert queries()["b20_compression"](spark, SF).count() <= n
    svd = queries()["b22_sequence_svd"](spark, SF)
    assert svd.count() <= n and len([c for c in svd.columns if c.startswith("seqo_")]) == 8
