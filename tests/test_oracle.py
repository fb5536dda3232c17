"""Every registered query with an SQL counterpart, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from veilsight.plans import finding_queries, scan_queries, text_queries, url_queries  # noqa: F401
from veilsight.plans.registry import QUERIES, SQL


def plain(v):
    if v is None or isinstance(v, float) and v != v:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from read_parquet('{sf}/{f}')")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    theirs = sorted(([plain(r[names.index(c)]) for c in cols] for r in got.fetchall()), key=repr)
    assert ours == theirs
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_pacing_against_a_loop(spark, sf):
    kinds = ["OK", "REFUSED", "OK", "OTHER", "FILE", "OK", "OK", "TRANSIENT"]
    logs = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect():
        logs.setdefault(r["user_id"], []).append(kinds[r["event_id"] % 8])
    want = {}
    for user, log in logs.items():
        delay = good = 0
        for k in log:
            if k == "REFUSED":
                delay, good = min(3000, max(300, delay * 2)), 0
            elif k == "OK" and delay:
                good += 1
                if good >= 30:
                    delay, good = (delay // 2 if delay // 2 >= 300 else 0), 0
        want[user] = delay
    got = {r["user_id"]: r["delay_ms"] for r in QUERIES["crawl_pacing"](spark, sf).collect()}
    assert got == want
