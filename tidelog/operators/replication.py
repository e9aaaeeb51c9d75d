"""Replicas of one key: reads and writes with tunable consistency.

Consistency is clamped to 1 .. replication factor; a read takes the newest of the first answers, a write counts acks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Consistency:
    """How many replicas must answer: fixed(n), QUORUM or ALL."""

    kind: str
    n: int = 0

    @staticmethod
    def fixed(n: int) -> Consistency:
        if n < 1:
            raise ValueError("consistency must be 1 at least")
        return Consistency("fixed", n)

    def needed(self, replication_factor: int) -> int:
        if replication_factor < 1:
            raise ValueError("replication factor must be 1 at least")
        return {"fixed": min(self.n, replication_factor), "quorum": replication_factor // 2 + 1, "all": replication_factor}[self.kind]

    def column(self, replication_factor: Column) -> Column:
        return {"fixed": F.least(F.lit(self.n), replication_factor), "quorum": F.floor(replication_factor / 2) + 1, "all": replication_factor}[self.kind].cast("int")


Consistency.QUORUM, Consistency.ALL = Consistency("quorum"), Consistency("all")


def reconcile(answers: DataFrame, keys: tuple[str, ...] = ("collection", "key"), local: str | None = None) -> DataFrame:
    """The winning answer of each key: greatest timestamp, then the ``local`` node's, then arrival, then the greatest node."""
    own = (F.col("node") == local).cast("int") if local is not None else F.lit(0)
    rest = [c for c in answers.columns if c not in keys]
    best = answers.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts_nanos", own.alias("own"), "seq", "node")).alias("_b"))
    return best.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in answers.columns])


def read(answers: DataFrame, needed: int, keys: tuple[str, ...] = ("collection", "key"), local: str | None = None) -> DataFrame:
    """The newest of the first ``needed`` answers of each key, with answered (as many as were there) and acks_met.

    The ``local`` node's answer comes first, if it is there, and then those that came, by replica_index: a silent replica is
    passed over.  A row is an answer even if it holds no entry (null ts_nanos).  Equal timestamps: the local answer, then
    arrival, then the first replica.  Too few answers still give a result; acks_met says so."""
    own = (F.col("node") == local).cast("int") if local is not None else F.lit(0)
    rest = [c for c in answers.columns if c not in keys]
    order = F.struct((-own).alias("far"), F.col("replica_index"), F.struct("ts_nanos", own.alias("own"), "seq", (-F.col("replica_index")).alias("early")).alias("rank"), F.struct(*rest).alias("row"))
    first = answers.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(order)), 1, needed).alias("_a"))  # an answer a replica
    best = F.array_max(F.transform("_a", lambda x: F.struct(x["rank"], x["row"])))["row"]
    told = first.select(*keys, best.alias("_b"), F.size("_a").cast("long").alias("answered"))
    return told.select(*[F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in answers.columns], "answered", (F.col("answered") >= needed).alias("acks_met"))


def applied(messages: DataFrame, catalog: DataFrame) -> DataFrame:
    """``messages`` of replicas (kind: set, delete or get; collection) with outcome, as a replica answers them: a set of a
    collection it doesn't know fails, a delete is fine, a get gives nothing."""
    known = catalog.select(F.col("name").alias("collection"), F.lit(True).alias("_known"))
    missing = F.when(F.col("kind") == "set", "collection_not_found").when(F.col("kind") == "get", "none").otherwise("ok")
    return messages.join(known, "collection", "left").withColumn("outcome", F.when(F.col("_known"), "ok").otherwise(missing)).select(*messages.columns, "outcome")


def acks(writes: DataFrame, consistency: Consistency, keys: tuple[str, ...] = ("collection", "key", "seq")) -> DataFrame:
    """keys, acks, needed, acks_met of writes (replication_factor and ok of every replica)."""
    counted = writes.groupBy(*keys).agg(F.count(F.when(F.col("ok"), 1)).alias("acks"), F.max("replication_factor").alias("_rf"))
    needed = consistency.column(F.col("_rf"))
    return counted.select(*keys, "acks", needed.alias("needed"), (F.col("acks") >= needed).alias("acks_met"))


def stale(answers: DataFrame, keys: tuple[str, ...] = ("collection", "key")) -> DataFrame:
    """The answers that are behind the newest of their key, with behind_nanos."""
    newest = F.max("ts_nanos").over(Window.partitionBy(*keys))
    return answers.withColumn("behind_nanos", newest - F.col("ts_nanos")).where("behind_nanos > 0")
