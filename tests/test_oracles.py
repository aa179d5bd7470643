"""Every query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from loomwork.plans import catalog
from loomwork.shipping import ship

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    return float(value) if hasattr(value, "__float__") else value


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_query_equals_oracle(spark, database, name):
    ship(spark)
    got = catalog.queries()[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    cursor = database.execute(catalog.oracles()[name])
    at = {d[0]: i for i, d in enumerate(cursor.description)}
    assert sorted(at) == columns
    expected = sorted((tuple(plain(r[at[c]]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert rows == expected


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracles())))
def test_query_without_oracle_runs(spark, name):
    ship(spark)
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_approximate_indexes_have_recall(spark):
    ship(spark)
    q = catalog.queries()
    true = {(r.qid, r.did) for r in q["knn_topk"](spark, FOLDER).collect()}
    for name in ("ivf_topk", "lsh_topk"):
        found = {(r.qid, r.did) for r in q[name](spark, FOLDER).collect()}
        assert len(true & found) / len(true) >= 0.9, name
