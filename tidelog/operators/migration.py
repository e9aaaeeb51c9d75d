"""What moves when the ring changes: the difference of two placements.

A replica that is new after the change is sent from the key's first replica of before that is still there; one that is no
longer placed is deleted.  A key whose replicas of before are all gone can't be sent and is marked lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ring import placement


def plan(keys: DataFrame, before: DataFrame, after: DataFrame, replication_factor: int) -> DataFrame:
    """``keys`` (with key_hash, a row a key) with action (send, delete or lost), from_shard and to_shard."""
    names = keys.columns
    sides = placement(keys, before, replication_factor).withColumn("_was", F.lit(True)).unionByName(placement(keys, after, replication_factor).withColumn("_was", F.lit(False)))
    alive = after.select("shard", F.lit(True).alias("_alive"))
    marked = sides.join(F.broadcast(alive), "shard", "left")  # a row a shard of the ring
    by_key = marked.groupBy(*names).agg(
        F.collect_set(F.when(F.col("_was"), F.col("shard"))).alias("_old"), F.collect_set(F.when(~F.col("_was"), F.col("shard"))).alias("_new"),
        F.min_by(F.when(F.col("_was") & F.col("_alive"), F.col("shard")), F.when(F.col("_was") & F.col("_alive"), F.col("replica_index"))).alias("_source"),
        F.collect_set(F.when(F.col("_was") & F.col("_alive"), F.col("shard"))).alias("_left"),
    )
    none = F.lit(None).cast("string")
    sent = F.transform(F.array_except("_new", "_old"), lambda s: F.struct(F.when(F.col("_source").isNull(), "lost").otherwise("send").alias("action"), F.col("_source").alias("from_shard"), s.alias("to_shard")))
    gone = F.transform(F.array_except("_left", "_new"), lambda s: F.struct(F.lit("delete").alias("action"), s.alias("from_shard"), none.alias("to_shard")))
    return by_key.select(*names, F.explode(F.concat(sent, gone)).alias("_m")).select(*names, "_m.*")


def apply(stored: DataFrame, moves: DataFrame, now_nanos: int | None = None, mode: str = "remove") -> DataFrame:
    """The entries of every shard after ``moves``; ``stored`` has key_hash, key and shard.

    Sent entries keep their timestamps.  mode 'remove' takes deleted entries away; 'tombstone' adds a tombstone stamped
    ``now_nanos``, which would win against the same entry if it ever came back."""
    on = ["collection", "key"]
    sends = moves.where("action = 'send'").select(*on, F.col("from_shard").alias("shard"), "to_shard")
    sent = stored.join(sends, [*on, "shard"]).withColumn("shard", F.col("to_shard")).select(*stored.columns)
    deletes = moves.where("action = 'delete'").select(*on, F.col("from_shard").alias("shard"))
    if mode == "remove":
        return stored.join(deletes, [*on, "shard"], "left_anti").unionByName(sent)
    if mode != "tombstone" or now_nanos is None:
        raise ValueError("mode is 'remove', or 'tombstone' with now_nanos")
    dead = stored.join(deletes, [*on, "shard"], "left_semi").dropDuplicates([*on, "shard"]).withColumns({"data": F.unhex(F.lit("")), "is_tombstone": F.lit(True), "ts_nanos": F.lit(now_nanos).cast("long")})
    return stored.unionByName(sent).unionByName(dead.select(*stored.columns))
