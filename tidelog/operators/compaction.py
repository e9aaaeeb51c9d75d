"""Compaction: which containers to merge, and the merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lww import newest


def containers(log: DataFrame) -> DataFrame:
    """collection, container_id, entries, bytes of every container."""
    size = 32 + F.octet_length("key") + F.octet_length("data")
    return log.groupBy("collection", "container_id").agg(F.count("*").alias("entries"), F.sum(size.cast("long")).alias("bytes"))


def tier():
    """Power of two of the number of entries."""
    return F.length(F.bin("entries")) - 1


def size_tiers(sizes: DataFrame) -> DataFrame:
    """collection, tier, containers, entries of the containers by the power of two of their entries."""
    return sizes.where("entries > 0").groupBy("collection", tier().alias("tier")).agg(F.count("*").alias("containers"), F.sum("entries").alias("entries"))


def candidates(sizes: DataFrame, factor: int = 2) -> DataFrame:
    """collection, tier, container_id of the containers to merge, group by group.

    From the smallest tier up, a tier whose entries would together reach a larger tier hands its containers on to the tier
    they reach, if that has any; groups of at least max(2, ``factor``) containers are merged.  A factor below 2 plans
    nothing.  Tiers are at most 64 a collection, so each collection's cascade is one row's fold."""
    ranked = sizes.where("entries > 0").withColumn("tier", tier())
    if factor < 2:
        return ranked.select("collection", "tier", "container_id").where(F.lit(False))
    counted = ranked.groupBy("collection", "tier").agg(F.sum("entries").alias("entries"))
    tiers = counted.groupBy("collection").agg(F.sort_array(F.collect_list(F.struct("tier", "entries"))).alias("tiers"))
    # carried: what lower tiers hand on; moves: from tier to tier
    start = F.struct(F.lit(None).cast("int").alias("to"), F.lit(0).cast("long").alias("carried"), F.array().cast("array<struct<from:int,to:int>>").alias("moves"))

    def step(acc, x):
        total = x["entries"] + F.when(acc["to"] == x["tier"], acc["carried"]).otherwise(F.lit(0).cast("long"))
        reach = (F.length(F.bin(total)) - 1).cast("int")
        moves = F.concat(acc["moves"], F.array(F.struct(x["tier"].cast("int").alias("from"), F.when(reach > x["tier"], reach).otherwise(x["tier"]).cast("int").alias("to"))))
        return F.struct(F.when(reach > x["tier"], reach).cast("int").alias("to"), F.when(reach > x["tier"], total).otherwise(F.lit(0).cast("long")).alias("carried"), moves.alias("moves"))

    folded = tiers.select("collection", F.aggregate("tiers", start, step)["moves"].alias("moves"), F.transform("tiers", lambda t: t["tier"].cast("int")).alias("known"))
    # a tier's group: follow its moves as long as they lead to a tier that exists
    follow = lambda t, moves, known: F.aggregate(moves, t, lambda at, m: F.when((m["from"] == at) & F.array_contains(known, m["to"]), m["to"]).otherwise(at))
    groups = folded.select("collection", F.explode("known").alias("tier"), "moves", "known").select("collection", "tier", follow(F.col("tier"), F.col("moves"), F.col("known")).alias("group"))
    placed = ranked.join(groups, ["collection", "tier"])
    enough = placed.withColumn("_n", F.count("*").over(Window.partitionBy("collection", "group"))).where(F.col("_n") >= max(2, factor))
    return enough.select("collection", F.col("group").alias("tier"), "container_id")


def by_replica(log: DataFrame, keep_tombstones: bool) -> DataFrame:
    """``log`` merged as every replica would merge its own: of each key the newest entry that all replicas have (null node),
    and the newer ones that only some nodes have.  Without ``keep_tombstones``, keys go of which only tombstones are left."""
    rest = [c for c in log.columns if c not in ("collection", "key")]
    newest_of = newest(log, ("collection", "key", "node")).select(*log.columns)
    row = F.struct(F.struct("ts_nanos", "seq").alias("at"), F.struct(*rest).alias("row"))
    keys = newest_of.groupBy("collection", "key").agg(F.collect_list(row).alias("_e"))  # a row a node at the most
    shared = F.get(F.filter("_e", lambda x: x["row"]["node"].isNull()), F.lit(0))["at"]
    left = keys.withColumn("_e", F.filter("_e", lambda x: x["row"]["node"].isNull() | shared.isNull() | (x["at"] > shared)))
    if not keep_tombstones:
        left = left.where(F.exists("_e", lambda x: ~x["row"]["is_tombstone"]))
    out = left.select("collection", "key", F.explode("_e.row").alias("_r"))
    return out.select(*[F.col(c) if c in ("collection", "key") else F.col(f"_r.{c}").alias(c) for c in log.columns])


def next_index(sizes: DataFrame) -> DataFrame:
    """collection, next_flush (even), next_compaction (odd)."""
    odd = F.col("container_id") % 2 == 1
    even_top, odd_top = F.max(F.when(~odd, F.col("container_id"))), F.max(F.when(odd, F.col("container_id")))
    return sizes.groupBy("collection").agg((F.coalesce(even_top, F.lit(-2)) + 2).cast("int").alias("next_flush"), (F.coalesce(odd_top, F.lit(-1)) + 2).cast("int").alias("next_compaction"))


def compact(log: DataFrame, chosen: list[int] | None = None, keep_tombstones: bool | None = None, output: int = 1) -> DataFrame:
    """The log with the ``chosen`` containers (all by default) merged into container ``output``.

    Tombstones go only if all containers take part, unless told otherwise: elsewhere an older container could bring the
    key back."""
    whole = chosen is None
    inside = log if whole else log.where(F.col("container_id").isin([int(c) for c in chosen]))
    keep = (not whole) if keep_tombstones is None else keep_tombstones
    merged = newest(inside)
    if not keep:
        merged = merged.where(~F.col("is_tombstone"))
    merged = merged.withColumn("container_id", F.lit(output).cast("int"))
    return merged if whole else log.where(~F.col("container_id").isin([int(c) for c in chosen])).unionByName(merged)
