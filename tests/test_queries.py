"""Every registered query against its SQL in DuckDB."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from murmura import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        out.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return out


def rows(df):
    def one(x):
        return None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted(repr(tuple(one(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    ours, theirs = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(ORACLES) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries())


def test_sdi_add_up_to_errors(spark):
    a = QUERIES["wer_sdi"](spark, DATA).toPandas().set_index("speaker").sum(axis=1)
    b = QUERIES["wer_errors_by_speaker"](spark, DATA).toPandas().set_index("speaker")["errors"]
    assert (a.sort_index() == b.sort_index()).all()
