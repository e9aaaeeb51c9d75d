"""Last write wins: the newest entry of each key, by timestamp and then order of arrival.

Entries meet by one aggregation on the key, combined before the shuffle, so a key with very many versions sends one row
a task.  Merging is idempotent, commutative and associative as long as (ts_nanos, seq) tells a key's entries apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("ts_nanos", "seq")


def newest(log: DataFrame, keys: tuple[str, ...] = ("collection", "key"), order: tuple[str, ...] = ORDER) -> DataFrame:
    """The row of the greatest ``order`` of each key, with the columns of ``log``."""
    rest = [c for c in log.columns if c not in keys]
    top = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_top"))
    return top.select(*[F.col(c) if c in keys else F.col(f"_top.{c}").alias(c) for c in log.columns])


def latest(log: DataFrame, keys: tuple[str, ...] = ("collection", "key")) -> DataFrame:
    """The newest entry of each key, tombstones included."""
    return newest(log, keys)


def live(log: DataFrame, keys: tuple[str, ...] = ("collection", "key")) -> DataFrame:
    """The newest entry of each key that isn't deleted."""
    return latest(log, keys).where(~F.col("is_tombstone"))


def of_newest_container(log: DataFrame, keys: tuple[str, ...] = ("collection", "key")) -> DataFrame:
    """The entry of each key in the newest container that has it, whatever its timestamp: what one replica reads first."""
    return newest(log, keys, ("container_id", *ORDER))
