"""The queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from moiety.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows_as_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    asked = con.execute(queries.ORACLES[name])
    names = [c[0] for c in asked.description]
    order = sorted(names)
    assert order == sorted(got.columns)
    pick = lambda rows, cols: sorted(tuple(str(r[cols.index(c)]) for c in order) for r in rows)
    assert pick([tuple(r) for r in got.collect()], got.columns) == pick(asked.fetchall(), names)


def test_all_eleven_are_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 11)) and "pipeline" in queries.QUERIES
