"""The op-log: one row for each set or delete.

collection, key (MessagePack bytes), data (a document's bytes; empty for a delete), is_tombstone, ts_nanos (a long, as
microseconds would make false ties), seq (order of arrival), node, shard and container_id (even: flushed, odd: compacted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import murmur3

_TYPES = {
    "collection": T.StringType(), "key": T.BinaryType(), "key_hash": T.LongType(), "data": T.BinaryType(), "is_tombstone": T.BooleanType(),
    "ts_nanos": T.LongType(), "seq": T.LongType(), "node": T.StringType(), "shard": T.StringType(), "container_id": T.IntegerType(),
}
SCHEMA = T.StructType([T.StructField(k, t) for k, t in _TYPES.items()])


def nanos(ts: Column) -> Column:
    """Nanoseconds since 1970 of a timestamp without time zone; no session setting matters."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts) * 1000


def oplog(rows: DataFrame, key: Column, data: Column, ts_nanos: Column, seq: Column, tombstone: Column | None = None, collection: str = "default", node: Column | None = None, container_id: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` as an op-log, with columns ``keep`` of theirs; a tombstone's data is empty."""
    gone = F.coalesce(tombstone, F.lit(False)) if tombstone is not None else F.lit(False)
    columns = {
        "collection": F.lit(collection), "key": key, "key_hash": murmur3(key), "data": F.when(gone, F.unhex(F.lit(""))).otherwise(data), "is_tombstone": gone,
        "ts_nanos": ts_nanos.cast("long"), "seq": seq.cast("long"), "node": node if node is not None else F.lit(None).cast("string"),
        "shard": F.lit(None).cast("string"), "container_id": (container_id if container_id is not None else F.lit(0)).cast("int"),
    }
    return rows.select(*keep, *[c.alias(k) for k, c in columns.items()])


def checked(log: DataFrame) -> DataFrame:
    """``log``; a row with a null key, or a set of null or empty data, fails the job when it is reached."""
    bad = F.col("key").isNull() | (~F.col("is_tombstone") & (F.col("data").isNull() | (F.octet_length("data") == 0)))
    message = F.lit("MissingField: a set needs a key and a value, a delete a key")
    return log.withColumn("key", F.when(bad, F.raise_error(message).cast("binary")).otherwise(F.col("key")))
