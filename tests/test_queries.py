"""Every query of the core against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tessella import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        return round(v, 9) + 0.0 if isinstance(v, float) and math.isfinite(v) else v

    return sorted((tuple(plain(r[k]) for k in order) for r in values), key=repr)


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query(spark, data, db, name):
    df = Q.QUERIES[name](spark, data)
    got = rows(df.columns, df.collect())
    found = db.execute(Q.ORACLES[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows(columns, found.fetchall())
    assert len(got) == len(want) and got == want


def test_geodesic_round_trip_on_the_antimeridian(spark, tmp_path):
    """Keys beyond the small tables: multiples of 36,000 lie at -180 degrees, on either side of which the way back may end."""
    keys = sorted({36000 * k for k in range(30)} | {17999, 18000, 35999, 36001, 59999})
    spark.createDataFrame([(k,) for k in keys], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    df = Q.QUERIES["geodesic_round_trip"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    found = con.execute(Q.ORACLES["geodesic_round_trip"])
    columns = [c[0] for c in found.description]
    want = rows(columns, found.fetchall())
    assert len(want) == len(keys) and rows(df.columns, df.collect()) == want


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
