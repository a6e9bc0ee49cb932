"""Every query of the catalogue against its SQL on the smallest tables."""

import duckdb
import pytest

from tracewell.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df, columns):
    df = df[columns].copy()
    for c in columns:
        if df[c].dtype.kind in "fiu":
            df[c] = df[c].astype(float).round(6)
        elif str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]")
    return sorted(map(str, df.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_same_rows(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


def test_human_format_of_large_ids(spark, tmp_path):
    """Ids up to 6 million, where numbers pass 1e9 and 2^30."""
    duckdb.sql(f"COPY (SELECT * REPLACE (event_id * 6000 + event_id % 7 AS event_id) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalog.QUERIES["human_format"](spark, str(tmp_path)).toPandas()
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = c.sql(catalog.ORACLE["human_format"]).df()
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
