"""Reads: by key, by many keys, by ranges of keys or hashes, by predicate, and the raw log.

Filters are on plain columns, so they reach the files; key ranges compare bytes, hash ranges go round the ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import in_interval
from .lww import latest


def raw(log: DataFrame) -> DataFrame:
    """The version log as it lies in the containers: by container and key, with tombstones and shadowed versions."""
    return log.orderBy("container_id", "key", "ts_nanos", "seq")


def filtered(log: DataFrame, predicate: Column) -> DataFrame:
    """Entries, of any version, that fulfil a predicate on key, value or timestamp."""
    return log.where(predicate)


def key_range(log: DataFrame, start: bytes | None = None, end: bytes | None = None) -> DataFrame:
    """Entries with start <= key < end, in bytes."""
    out = log
    if start is not None:
        out = out.where(F.col("key") >= F.lit(bytearray(start)))
    return out.where(F.col("key") < F.lit(bytearray(end))) if end is not None else out


def hash_range(log: DataFrame, start: int, end: int) -> DataFrame:
    """Entries whose key's hash is in (start, end] on the ring."""
    h = F.col("key_hash")
    if start < end:  # plain comparisons, which files can skip by
        return log.where((h > start) & (h <= end))
    return log.where(in_interval(h, F.lit(start), F.lit(end)))


def key_exactly(log: DataFrame, key: bytes) -> DataFrame:
    """All versions of one key."""
    return log.where(F.col("key") == F.lit(bytearray(key)))


def point(log: DataFrame, key: bytes) -> DataFrame:
    """The live entry of one key, or no row."""
    return latest(log.where(F.col("key") == F.lit(bytearray(key)))).where(~F.col("is_tombstone"))


def many(log: DataFrame, keys: DataFrame) -> DataFrame:
    """collection, key, data, found of every asked key (collection, key); one row a key."""
    asked = keys.select("collection", "key").distinct()
    mine = latest(log.join(asked, ["collection", "key"], "left_semi"))
    out = asked.join(mine.drop("found"), ["collection", "key"], "left")
    return out.withColumn("found", F.coalesce(~F.col("is_tombstone"), F.lit(False))).withColumn("data", F.when(F.col("found"), F.col("data")))
