"""Every registered query against its DuckDB oracle on the smallest generated tables
(the driver runs the same comparison at sf0.01)."""

import os

import duckdb
import pytest

from conftest import ROOT  # noqa: F401
from tools.compare import TABLES, digest

import __spark_entry__ as E
from threadlens.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_every_query_has_an_oracle_or_is_a_model_hook():
    assert set(catalog.QUERIES) <= set(E.queries()) and set(catalog.ORACLE) <= set(E.oracle_sql())
    missing = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert missing == set()


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "priority_score" in df.columns


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    srows, scols = [tuple(r) for r in df.collect()], df.columns
    rel = con.sql(E.oracle_sql()[name])
    drows, dcols = rel.fetchall(), rel.columns
    assert sorted(scols) == sorted(dcols)
    assert len(srows) == len(drows)
    assert digest(srows, scols)[0] == digest(drows, dcols)[0]


@pytest.mark.parametrize("name", ["model_summary", "summary_method"])
def test_model_hook_rows(spark, con, name):
    n = E.queries()[name](spark, SF).count()
    assert n == E.queries()["identify_threads"](spark, SF).count()
