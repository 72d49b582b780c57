"""Every registered query that has SQL gives the same rows in DuckDB."""

from __future__ import annotations

import math
import os

import pytest

from marginalia.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():  # noqa: ANN201
    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v: object) -> str:
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str([plain(x) for x in v]) if isinstance(v, list) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, duck, name):  # noqa: ANN001
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert name in ORACLES
    cur = duck.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    got = sorted(tuple(plain(r[c]) for c in order) for r in rows)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in cur.fetchall())
    assert got == want


def test_filters_reach_the_scan(spark):  # noqa: ANN001
    df = QUERIES["usage_by_day"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "event_type" in read and "event_id" not in read

