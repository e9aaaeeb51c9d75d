"""Plans that the engine should keep: pushed filters, pruned columns, one shuffle for a merge, no Python in the way."""

import os
import re

import pytest
from pyspark.sql import functions as F

from tidelog.api import Engine
from tidelog.functions.msgpack import encode_int
from tidelog.operators import lww, scan
from tidelog.plans import queries as engine

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    mine = Engine(spark, f"file://{tmp_path_factory.mktemp('db')}").create_collection("users")
    mine.set_many(spark.range(1000).select(encode_int(F.col("id")).alias("key"), F.encode(F.col("id").cast("string"), "UTF-8").alias("data")))
    return mine


def test_ranges_reach_the_files(users):
    by_hash = plan(users.scan(hash_range=(10, 500)).select("key"))
    assert "GreaterThan(key_hash,10)" in by_hash and "LessThanOrEqual(key_hash,500)" in by_hash
    assert re.search(r"ReadSchema: struct<key:binary,key_hash:bigint>", by_hash)
    by_key = plan(users.scan(key_range=(b"\x01", b"\x05")).select("key"))
    assert "GreaterThanOrEqual(key," in by_key and "LessThan(key," in by_key
    assert "EqualTo(key_hash," in plan(users.get(5))


def test_a_merge_is_one_shuffle_with_combined_entries(users):
    for df in (users.live(), users.entries(), lww.of_newest_container(users.raw_log())):
        assert shuffles(df) == 1 and "partial_max_by" in plan(df)


def test_many_gets_read_by_the_keys(spark, users):
    asked = spark.range(5).select(F.lit("users").alias("collection"), encode_int(F.col("id")).alias("key"))
    assert "LeftSemi" in plan(scan.many(users.raw_log(), asked))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(set(engine.queries()) - {"flush_by_distinct_keys", "stream_live_by_key"}))
def test_no_python_on_the_executors(spark, name):
    shown = plan(engine.queries()[name](spark, DATA))
    assert not re.search(r"Python|Pandas|Arrow(?!Convert)", shown) and "CartesianProduct" not in shown
