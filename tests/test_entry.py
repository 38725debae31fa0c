"""The registry's contract, and some queries held against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_registry():
    known, sql = entry.queries(), entry.oracle_sql()
    assert len(known) >= 60 and set(sql) <= set(known)


def canon(rows):
    return sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", ["signal_decay_edges", "multi_seed_merge", "updown_top5", "top_locations", "normalised_ids", "staged_candidates"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    expected = con.execute(f"select {', '.join(columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert canon(tuple(r) for r in df.select(*columns).collect()) == canon(expected)
