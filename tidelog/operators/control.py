"""Metadata: collections, nodes and the gossip that carries them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_SEEN = 3
EXPIRE_NANOS = 30_000_000_000


def gossip_counts(events: DataFrame, most_seen: int = MOST_SEEN) -> DataFrame:
    """``events`` (source, kind, payload, ts_nanos) with seen, handled (the first of source and kind) and forwarded."""
    seen = F.row_number().over(Window.partitionBy("source", "kind").orderBy("ts_nanos", "payload"))
    return events.withColumn("seen", seen).withColumns({"handled": F.col("seen") == 1, "forwarded": F.col("seen") <= most_seen})


def gossip_with_expiry(events: DataFrame, most_seen: int = MOST_SEEN, expire_nanos: int = EXPIRE_NANOS) -> DataFrame:
    """:func:`gossip_counts` as a node with a clock counts: the first event beyond ``most_seen`` starts a timer, and after
    ``expire_nanos`` the count of its source and kind begins anew.  Events beyond have seen = most_seen + 1.

    The count depends on all events before, so each source and kind is one fold; that is control traffic, not data."""
    start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("long").alias("timer"), F.array().cast("array<int>").alias("seen"))

    def step(acc, x):
        over = acc["timer"].isNotNull() & (x["ts_nanos"] >= acc["timer"] + expire_nanos)
        n = F.when(over, 0).otherwise(acc["n"])
        counted = n < most_seen
        timer = F.when(over | acc["timer"].isNull(), F.when(counted, F.lit(None).cast("long")).otherwise(x["ts_nanos"])).otherwise(acc["timer"])
        return F.struct(F.when(counted, n + 1).otherwise(n).alias("n"), timer.alias("timer"), F.concat(acc["seen"], F.array(F.when(counted, n + 1).otherwise(most_seen + 1))).alias("seen"))

    listed = events.groupBy("source", "kind").agg(F.sort_array(F.collect_list(F.struct("ts_nanos", "payload"))).alias("e"))
    folded = listed.select("source", "kind", F.explode(F.arrays_zip("e", F.aggregate("e", start, step)["seen"].alias("seen"))).alias("x"))
    out = folded.select("source", "kind", F.col("x.e.payload").alias("payload"), F.col("x.e.ts_nanos").alias("ts_nanos"), F.col("x.seen").alias("seen"))
    return out.withColumns({"handled": F.col("seen") == 1, "forwarded": F.col("seen") <= most_seen})


def self_announcements(events: DataFrame, alive: DataFrame) -> DataFrame:
    """The Alive events with which the nodes that live (node) answer events that call them dead."""
    about = events.where("kind = 'Dead'").join(alive.select(F.col("node").alias("payload")), "payload", "left_semi")
    return about.select(F.col("payload").alias("source"), F.lit("Alive").alias("kind"), "payload", "ts_nanos")


def fanout(nodes: DataFrame, sources: DataFrame, k: int = 3, seed: int = 0) -> DataFrame:
    """source, node: the ``k`` other nodes that each source gossips to, chosen by a seeded hash.

    Both are tables of a cluster's nodes, and each source draws among all of them."""
    pairs = sources.select(F.col("node").alias("source")).join(F.broadcast(nodes.select("node")), F.col("source") != F.col("node"))
    drawn = F.row_number().over(Window.partitionBy("source").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "source", "node")), "node"))
    return pairs.withColumn("_k", drawn).where(F.col("_k") <= k).drop("_k")


def distinct_events(events: DataFrame) -> DataFrame:
    """Each event (source, kind, payload) at its first time: two collections of one source are two events."""
    return events.groupBy("source", "kind", "payload").agg(F.min("ts_nanos").alias("ts_nanos"))


def nodes_alive(events: DataFrame) -> DataFrame:
    """node of all whose newest event is Alive (payload: the node's name)."""
    mine = events.where(F.col("kind").isin("Alive", "Dead"))
    return mine.groupBy(F.col("payload").alias("node")).agg(F.max_by("kind", F.struct("ts_nanos", "kind")).alias("kind")).where("kind = 'Alive'").select("node")


def collections(events: DataFrame) -> DataFrame:
    """name of all whose newest event is CreateCollection."""
    mine = events.where(F.col("kind").isin("CreateCollection", "DropCollection"))
    return mine.groupBy(F.col("payload").alias("name")).agg(F.max_by("kind", F.struct("ts_nanos", "kind")).alias("kind")).where("kind = 'CreateCollection'").select("name")


def cluster_metadata(nodes: DataFrame, catalog: DataFrame) -> DataFrame:
    """One row: nodes, a list of structs in order of name, and collections, a map of replication factors."""
    listed = nodes.agg(F.sort_array(F.collect_list(F.struct(*nodes.columns))).alias("nodes"))
    named = catalog.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "replication_factor")))).alias("collections"))
    return listed.join(F.broadcast(named))  # one row with one row


def create(catalog: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` (name, replication_factor) with created: whether the name was free; of equal names the first factor counts."""
    one = asked.groupBy("name").agg(F.min("replication_factor").alias("replication_factor"))
    known = catalog.select("name", F.lit(True).alias("_known"))
    return one.join(known, "name", "left").select("name", "replication_factor", F.col("_known").isNull().alias("created"))


def drop(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """The catalog without ``names``."""
    return catalog.join(names.select("name"), "name", "left_anti")
