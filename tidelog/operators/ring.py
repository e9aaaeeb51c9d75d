"""Placement on a consistent-hash ring.

A shard "{node}-{id}" stands at the hash of its name and owns (previous shard, itself]; a key goes to the owner of its
hash, and its replicas to the next shards clockwise on distinct nodes.  The ring is a small table (a row a shard): each
interval's replicas are worked out once, and keys find their interval by a range join with the broadcast intervals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import clockwise, in_interval, let, murmur3

#: Shards of a ring that is broadcast; beyond, keys and intervals meet by slices of the hash.
MOST_SHARDS = 10_000
SLICE_BITS = 12
#: Shards that a walk looks at for each replica before it looks at the whole ring.
NEAR = 8


def ring(nodes: DataFrame) -> DataFrame:
    """hash, prev_hash, wraps, node, shard, shard_id of nodes (node, ids); a shard that is named twice counts once."""
    shards = nodes.select("node", F.explode("ids").alias("shard_id")).distinct()
    named = shards.select("node", F.concat_ws("-", "node", F.col("shard_id").cast("string")).alias("shard"), F.col("shard_id").cast("int").alias("shard_id"))
    placed = named.withColumn("hash", murmur3(F.encode("shard", "UTF-8")))
    order = Window.partitionBy().orderBy("hash", "shard")
    last = F.max("hash").over(Window.partitionBy())
    prev = F.lag("hash").over(order)
    return placed.select("hash", F.coalesce(prev, last).alias("prev_hash"), prev.isNull().alias("wraps"), "node", "shard", "shard_id")


def rotated(shards: DataFrame, shard: str) -> DataFrame:
    """The ring in clockwise order from ``shard``."""
    own = shards.where(F.col("shard") == shard).select(F.col("hash").alias("_own"))
    return shards.crossJoin(F.broadcast(own)).orderBy(clockwise(F.col("hash"), F.col("_own")), "shard").drop("_own")  # one row


def intervals(shards: DataFrame, replication_factor: int) -> DataFrame:
    """prev_hash, hash, replicas: an array of (node, shard) of each interval, the owner first.

    From each shard clockwise, the first shard of every node, as far as the factor goes (or the nodes do).  The ring is one
    row; each walk looks at ``NEAR`` shards a replica, and at the whole ring only where these have too few nodes."""
    whole = shards.agg(F.sort_array(F.collect_list(F.struct("hash", "shard", "node", "prev_hash"))).alias("_ring"))
    twice = whole.select("_ring", F.concat("_ring", "_ring").alias("_twice"), F.size(F.array_distinct("_ring.node")).alias("_nodes"))
    need = F.least(F.lit(replication_factor), F.col("_nodes"))

    def walk(i, steps):
        none = F.array().cast("array<struct<node:string,shard:string>>")
        met = lambda found, x: (F.size(found) >= need) | F.exists(found, lambda y: y["node"] == x["node"])
        add = lambda found, x: F.when(met(found, x), found).otherwise(F.concat(found, F.array(F.struct(x["node"].alias("node"), x["shard"].alias("shard")))))
        return F.aggregate(F.slice("_twice", i + 1, steps), none, add)

    size = F.size("_ring")
    near = lambda i: walk(i, F.least(size, F.lit(NEAR * replication_factor)))
    full = lambda i: let(near(i), lambda found: F.when(F.size(found) >= need, found).otherwise(walk(i, size)))
    walked = twice.select(F.explode(F.transform("_ring", lambda x, i: F.struct(x["prev_hash"].alias("prev_hash"), x["hash"].alias("hash"), full(i).alias("replicas")))).alias("_x"))
    return walked.select("_x.*")


def replicas(shards: DataFrame, replication_factor: int) -> DataFrame:
    """prev_hash, hash, replica_index, node, shard: a row for each replica of each interval."""
    found = intervals(shards, replication_factor)
    return found.select("prev_hash", "hash", F.posexplode("replicas").alias("replica_index", "_r")).select("prev_hash", "hash", "replica_index", "_r.node", "_r.shard")


def placement(keys: DataFrame, shards: DataFrame, replication_factor: int = 1) -> DataFrame:
    """``keys`` (with key_hash) with replica_index, node and shard, a row for each replica."""
    lists = intervals(shards, replication_factor).withColumnsRenamed({"hash": "_hash", "prev_hash": "_prev", "replicas": "_replicas"})
    h = F.col("key_hash")
    if shards.limit(MOST_SHARDS + 1).count() <= MOST_SHARDS:
        found = keys.join(F.broadcast(lists), in_interval(h, F.col("_prev"), F.col("_hash")))
    else:  # meet in slices of the hash; an interval lies in all slices that it touches
        slices = 1 << SLICE_BITS
        first, last = F.shiftright("_prev", 32 - SLICE_BITS), F.shiftright("_hash", 32 - SLICE_BITS)
        touched = F.when(F.col("_prev") < F.col("_hash"), F.sequence(first, last)).otherwise(F.concat(F.sequence(first, F.lit(slices - 1).cast("long")), F.sequence(F.lit(0).cast("long"), last)))
        found = keys.withColumn("_slice", F.shiftright(h, 32 - SLICE_BITS)).join(lists.withColumn("_slice", F.explode(F.array_distinct(touched))), "_slice").where(in_interval(h, F.col("_prev"), F.col("_hash")))
    return found.select(*[keys[c] for c in keys.columns], F.posexplode("_replicas").alias("replica_index", "_r")).select(*keys.columns, "replica_index", "_r.node", "_r.shard")


def owned(keys: DataFrame, shards: DataFrame, shard: str, replica_index: int = 0) -> DataFrame:
    """The ``keys`` of which ``shard`` is the replica of that index."""
    mine = placement(keys, shards, replica_index + 1)
    return mine.where((F.col("replica_index") == replica_index) & (F.col("shard") == shard)).select(*keys.columns)


def load(keys: DataFrame, shards: DataFrame, replication_factor: int = 1) -> DataFrame:
    """node, shard, owned, replicas: keys of every shard, those without any included."""
    placed = placement(keys.select("key_hash"), shards, replication_factor).groupBy("shard").agg(F.count(F.when(F.col("replica_index") == 0, 1)).alias("owned"), F.count("*").alias("replicas"))
    zero = F.lit(0).cast("long")
    return shards.select("node", "shard").join(placed, "shard", "left").select("node", "shard", F.coalesce("owned", zero).alias("owned"), F.coalesce("replicas", zero).alias("replicas"))


def closest(shards: DataFrame, origin: int) -> DataFrame:
    """The shard that is nearest clockwise from a place on the ring."""
    return shards.agg(F.min_by(F.struct(*shards.columns), F.struct(clockwise(F.col("hash"), F.lit(origin)), F.col("shard"))).alias("_s")).select("_s.*")
