"""Every query of the registry against its DuckDB SQL on the smallest tables."""

import duckdb
import pytest

from trapline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, 0 if v is None else v) for v in row)


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.select(*sorted(df.columns)).collect()]
    assert rows
    if name in registry.ORACLE_SQL:
        want = duck.sql(registry.ORACLE_SQL[name])
        assert sorted(want.columns) == sorted(df.columns)
        want = [tuple(r) for r in want.select(*[f'"{c}"' for c in sorted(want.columns)]).fetchall()]
        assert sorted(rows, key=key) == sorted(want, key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_adaptive_states_occur(spark):
    r = registry.QUERIES["adaptive_gate"](spark, "/root/testdata/sf0.01")
    seen = {x[0] for x in r.select("reason").distinct().collect()}
    assert {"no_start", "start_motion", "stay", "post_roll", "stop"} <= seen
    assert r.where("guard_active").count() and r.where("night and armed").count()
