import duckdb
import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
NAMES = ["O-sanitize", "O-degree-dist", "O-fork-stats", "O-bucket-log", "O-fpmeta-bucket", "O-lcc", "O-top-buildings", "O-q-label-bucketed"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_flagship(spark):
    assert entry.entry(spark).columns == ["src", "dst", "layer"]


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = con.sql(entry.oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)
    rows = lambda df: sorted(map(str, df[key].astype(float, errors="ignore").itertuples(index=False, name=None)))
    assert rows(got) == rows(want)
