"""Every registered query with SQL, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry_point

SF = "/root/testdata/sf0.001"
TABLES = "part orders lineitem events documents labels conversations embeddings".split()
SQL = entry_point.oracle_sql()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    df = entry_point.queries()[name](spark, SF)
    rel = con.execute(SQL[name])
    cols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(cols)
    want = _sorted(rel.fetchall())
    got = _sorted([tuple(r) for r in df.select(*[f"`{c}`" for c in cols]).collect()])
    assert got == want


def test_every_query_has_a_known_kind():
    without_sql = set(entry_point.queries()) - set(SQL)
    assert all(n == "pipeline" or n.startswith("op") for n in without_sql)


def test_entry(spark):
    metrics = {r["metric"]: r["value"] for r in entry_point.entry(spark).collect()}
    assert set(metrics) == {"accuracy", "precision", "recall", "f1", "roc_auc"}
