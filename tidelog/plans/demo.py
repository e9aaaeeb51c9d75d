"""The driver's tables as an op-log and a cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import murmur3
from ..functions.msgpack import encode_int, encode_string
from ..operators.ring import ring
from ..sources.oplog import nanos, oplog

#: Nodes of the demo cluster; each has two shards.
NODES, SHARDS, PER_CONTAINER = ("a", "b", "c"), (0, 1), 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as an op-log: an error deletes its user's document; every thousand events are a container."""
    rows = table(spark, sf_dir, "events")
    data = F.encode(F.concat_ws(":", "event_type", F.coalesce("props", F.lit(""))), "UTF-8")
    node = F.element_at(F.array(*map(F.lit, NODES)), (F.col("event_id") % 3 + 1).cast("int"))
    container = (F.floor(F.col("event_id") / PER_CONTAINER) * 2).cast("int")
    return oplog(rows, encode_int(F.col("user_id")), data, nanos(F.col("ts")), F.col("event_id"), F.col("event_type") == "error", "events", node, container, keep=("user_id",))


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """collection, o_orderkey, key, key_hash of every order."""
    key = encode_int(F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select(F.lit("orders").alias("collection"), "o_orderkey", key.alias("key"), murmur3(key).alias("key_hash"))


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = encode_string(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_name", key.alias("key"), murmur3(key).alias("key_hash"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as an op-log of distinct keys, flushed by capacity."""
    data = F.encode(F.concat_ws("|", "o_orderstatus", "o_orderpriority"), "UTF-8")
    return oplog(table(spark, sf_dir, "orders"), encode_int(F.col("o_orderkey")), data, nanos(F.col("o_orderdate")), F.col("o_orderkey"), collection="orders", keep=("o_orderkey",))


def nodes(spark: SparkSession, names: tuple[str, ...] = NODES) -> DataFrame:
    return spark.createDataFrame([(n, list(SHARDS)) for n in names], "node string, ids array<int>")


def demo_ring(spark: SparkSession, names: tuple[str, ...] = NODES) -> DataFrame:
    return ring(nodes(spark, names))
