"""Every query with an oracle, against DuckDB on the same tables."""

import glob
import os

import duckdb
import pytest

from kinelake import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, SF).toArrow()
    duck.register("got", got)
    duck.execute(f"CREATE OR REPLACE TABLE want AS {ORACLES[name]}")
    kinds = {t: {r[0]: r[1] for r in duck.execute(f"DESCRIBE {t}").fetchall()} for t in ("want", "got")}
    assert kinds["want"] == kinds["got"]
    columns = ", ".join(f'"{c}"' for c in kinds["want"])
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_oracle(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
