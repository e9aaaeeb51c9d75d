"""How entries lie in containers: offsets, flushes and log padding."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE, CAPACITY, INDEX_RECORD = 4096, 8192, 16


def entry_size():
    """Bytes of an entry: lengths of eight bytes before key and data, and a timestamp of sixteen."""
    return (32 + F.octet_length("key") + F.octet_length("data")).cast("long")


def key_size():
    return (8 + F.octet_length("key")).cast("long")


BUCKETS = 1024  # of a container's keys
RUN = 16  # bits of seq that one window takes


def _running(rows: DataFrame, group: list[str], bucket: str, order: list[str], sums: dict[str, F.Column]) -> DataFrame:
    """``rows`` with the sum of each column of ``sums`` over the rows before, within ``group`` and by ``bucket`` and ``order``.

    Sums run within buckets, and over the buckets' totals, so a group's rows don't meet in one task."""
    inside = Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    totals = rows.groupBy(*group, bucket).agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    over = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*group, bucket, *[F.coalesce(F.sum(f"_t_{k}").over(over), zero).alias(f"_b_{k}") for k in sums])
    own = rows.withColumns({f"_i_{k}": F.coalesce(F.sum(c).over(inside), zero) for k, c in sums.items()})
    on = functools.reduce(lambda a, b: a & b, [own[c].eqNullSafe(before[c]) for c in (*group, bucket)])
    joined = own.join(before, on)
    return joined.select(*[own[c] for c in rows.columns], *[(F.col(f"_i_{k}") + F.col(f"_b_{k}")).cast("long").alias(k) for k in sums])


def _key_bucket(log: DataFrame) -> DataFrame:
    """``log`` with _bucket, 0 to BUCKETS, which grows with the key: its place between its container's first and last keys, by
    the seven bytes after what these have in common."""
    group = ["collection", "container_id"]
    spans = log.groupBy(*group).agg(F.hex(F.min("key")).alias("_first"), F.hex(F.max("key")).alias("_last"))
    alike = F.levenshtein("_first", "_last") == 0
    differ = F.array_position(F.zip_with(F.split("_first", ""), F.split("_last", ""), lambda a, b: ~a.eqNullSafe(b)), True)
    at = F.when(alike, F.length("_first")).otherwise(F.floor((differ - 1) / 2) * 2).cast("int")  # whole bytes
    number = lambda digits, start: F.conv(F.rpad(F.substr(digits, start + 1, F.lit(14)), 14, "0"), 16, 10).cast("double")
    spans = spans.withColumn("_at", at).withColumns({"_low": number(F.col("_first"), F.col("_at")), "_high": number(F.col("_last"), F.col("_at"))}).drop("_first", "_last")
    placed = log.join(spans, group)
    place = (number(F.hex("key"), F.col("_at")) - F.col("_low")) * BUCKETS / (F.col("_high") - F.col("_low") + 1)
    return placed.withColumn("_bucket", F.floor(place).cast("int")).drop("_at", "_low", "_high")


def offsets(log: DataFrame) -> DataFrame:
    """``log`` with key_size, full_size and offset of each entry in its container, in order of key, and index_offset."""
    sized = _key_bucket(log.withColumns({"key_size": key_size(), "full_size": entry_size()}))
    one = F.lit(INDEX_RECORD).cast("long")
    out = _running(sized, ["collection", "container_id"], "_bucket", ["key", "ts_nanos", "seq"], {"offset": F.col("full_size"), "index_offset": one})
    return out.drop("_bucket")


def flush_unique(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``log`` of distinct keys with the container of each entry: every ``capacity`` arrivals of a shard are one flush.

    Where keys are distinct, arrivals need no memory of keys: containers are runs of seq.  seq must count a shard's arrivals
    from 0 without gaps, so no window over the whole log is needed."""
    return log.withColumn("container_id", (F.floor(F.col("seq") / capacity) * 2).cast("int"))


def flush(log: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``log`` with the container of each entry when keys repeat: a flush happens at ``capacity`` distinct keys.

    Where the next container begins depends on all arrivals before it, so each shard's arrivals stream through one task in
    order, which holds one container's keys and no more."""
    schema, names = log.schema, log.columns

    def run(frames):
        shard, held, container = None, set(), 0
        for frame in frames:
            out = []
            for c, s, k in zip(frame["collection"], frame["shard"], frame["key"]):
                if (c, s) != shard:
                    shard, held, container = (c, s), set(), 0
                k = bytes(k)
                if k not in held and len(held) == capacity:
                    held, container = set(), container + 2
                held.add(k)
                out.append(container)
            yield frame.assign(container_id=out)[names]

    return log.repartition("collection", "shard").sortWithinPartitions("collection", "shard", "seq").mapInPandas(run, schema)


def wal_records(log: DataFrame) -> DataFrame:
    """``log`` with wal_bytes of each record, padded beyond its end to the next page, and its wal_offset in its node's log."""
    padded = ((F.floor(entry_size() / PAGE) + 1) * PAGE).cast("long")
    sized = log.withColumns({"wal_bytes": padded, "_run": F.shiftright("seq", RUN)})
    return _running(sized, ["collection", "node"], "_run", ["seq"], {"wal_offset": F.col("wal_bytes")}).drop("_run")


def container_files(files: DataFrame, extension: str) -> DataFrame:
    """``files`` (name) that are a container's file of that extension, "<number>.<extension>", with container_id."""
    number = F.regexp_extract("name", rf"^(\d+)\.{re.escape(extension)}$", 1)
    return files.withColumn("container_id", F.when(number != "", number.cast("int"))).where("container_id is not null")


def replay(records: DataFrame) -> DataFrame:
    """What a log's replay gives: the last arrival of each key, whatever its timestamp."""
    from .lww import newest

    return newest(records, order=("seq",))
