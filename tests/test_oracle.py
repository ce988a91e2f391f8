"""Registered queries against their SQL twins on the smallest test data."""

import duckdb
import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"
SAMPLE = """match_phrase match_prefix match_all_terms yoy_growth top_actors pairs_orgs code_jaccard_window actor_dynamics
stratified_sample h_index growth_model_select funding_by_instrument suggest_terms describe_code europe_first_order""".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for n in check.NAMES.split():
        con.execute(f"create view {n} as select * from '{SF}/{n}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = check.rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    assert got == check.rows([d[0] for d in cur.description], cur.fetchall())
    assert got[1]


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
