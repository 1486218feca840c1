"""Every registered query against its SQL counterpart on the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import entry
from compare import TABLES, _table
from rillstone.plans import ORACLES, QUERIES
from rillstone.sources.files import table
from tests.conftest import plan_of

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, FOLDER)
    want = db.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert _table(got.columns, [tuple(r) for r in got.collect()]) == _table(names, want.fetchall())


HEAVY = [
    "length_parity", "rolling_sum", "rolling_min_by_last", "rolling_max_by", "rolling_avg", "velocity_1min", "join_asof",
    "join_inner", "join_left", "join_right", "join_full", "join_hint_broadcast_first", "join_hint_shuffle_hash_second",
    "join_theta", "sql_hint_broadcast", "fraud_score", "enrich_spend_by_segment", "pattern_fail_then_success", "avg_per_driver",
]


@pytest.mark.parametrize("name", HEAVY)
def test_query_when_every_key_is_heavy_and_nothing_is_small(spark, db, name):
    spark.conf.set("spark.rillstone.rowsPerTask", "15")
    spark.conf.set("spark.rillstone.broadcastRows", "3")
    try:
        test_query(spark, db, name)
    finally:
        spark.conf.unset("spark.rillstone.rowsPerTask")
        spark.conf.unset("spark.rillstone.broadcastRows")


def test_entry(spark):
    assert entry(spark).count() > 0


def test_scans_read_only_what_is_needed(spark):
    plan = plan_of(QUERIES["word_count"](spark, FOLDER))
    assert "ReadSchema: struct<event_type:string>" in plan
    plan = plan_of(QUERIES["word_count_filter"](spark, FOLDER))
    assert "StringStartsWith(event_type,e)" in plan
    plan = plan_of(QUERIES["frequent_buyers"](spark, FOLDER))
    assert "EqualTo(event_type,purchase)" in plan and "ReadSchema: struct<user_id:bigint,event_type:string>" in plan


def test_tables_load(spark):
    assert table(spark, FOLDER, "region").count() == 5
