"""Queries of the corpus operators against their SQL, on stored and on odd tables."""

import duckdb
import pytest

from veilsight.llm import license_scan, substring_dedup, suffix_dedup
from veilsight.llm.queries import ORACLE_SQL, QUERIES

from .conftest import rows_of
from .test_removal import rough

OPERATORS = {"op2_substring_dedup": substring_dedup.digest, "op4_license_scan": license_scan.licenses, "op7_suffix_dedup": suffix_dedup.digest}


def answers(sql, columns, **tables):
    c = duckdb.connect()
    for name, rows in tables.items():
        c.register(name, rows)
    got = c.execute(sql)
    at = [[d[0] for d in got.description].index(x) for x in columns]
    return sorted((tuple(r[k] for k in at) for r in got.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_stored(spark, sf, name):
    ours = QUERIES[name](spark, sf)
    theirs = answers(ORACLE_SQL[name], ours.columns, documents=spark.read.parquet(f"{sf}/documents.parquet").toArrow())
    assert rows_of(ours) == theirs


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
@pytest.mark.parametrize("table", ["odd", "rough", "empty"])
def test_odd(spark, request, name, table):
    df = rough(spark) if table == "rough" else request.getfixturevalue(table)
    ours = OPERATORS[name](df)
    assert rows_of(ours) == answers(ORACLE_SQL[name], ours.columns, documents=df.select("doc_id", "text").toArrow())
