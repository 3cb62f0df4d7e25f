"""Every query with SQL against an independent engine."""

from __future__ import annotations

import duckdb
import pytest
from compare import duck_rows, rows_of

from lumenloc.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns, expected = duck_rows(duck, catalog.ORACLES[name])
    assert sorted(df.columns) == columns
    assert rows_of(df, columns) == expected
    assert expected


def test_likeness_that_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    vectors = [[1.0, 0.0], [-0.00003, 1.0], [0.00003, 1.0], [0.0, 1.0], [-0.0004, 1.0], [-0.00015, 1.0], [0.00025, 1.0]]
    spark.createDataFrame([(k, v, k) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    for name in ("match_rows", "clean_output"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        own, sql = (sorted((tuple(map(str, r)) for r in rows), key=repr) for rows in (df.collect(), con.sql(catalog.ORACLES[name]).select(*df.columns).fetchall()))
        assert own == sql
    assert {"0.000", "-0.000"} <= {r.similarity for r in catalog.match_rows(spark, str(tmp_path)).collect()}


def test_sample_is_seeded(spark, sf_dir):
    first, second = (catalog.road_sample400(spark, sf_dir).collect() for _ in range(2))
    assert first == second
    assert len(first) == len(set(first))


def test_entry_module(spark, sf_dir):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())
