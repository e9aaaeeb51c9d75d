"""Latency statistics with exact percentiles of floor rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PERCENTILES = {"p50": (5, 10), "p90": (9, 10), "p99": (99, 100), "p999": (999, 1000)}


def bucket(value: F.Column) -> F.Column:
    """A number that grows with the value: 64 to each power of two, on either side of 0; NaN is the greatest."""
    size = lambda v: F.floor(F.log2(v) * 64) + 100_000
    v = value.cast("double")
    return F.when(F.isnan(v), 1_000_000).when(v > 0, size(v)).when(v < 0, -size(-v)).otherwise(0).cast("long")


def latency(samples: DataFrame, value: str, by: tuple[str, ...] = ("op",)) -> DataFrame:
    """by, n, total, min, max, p50, p90, p99, p999: the sorted value at place (n - 1) * p, rounded down, none in between.

    Equal values are counted first, then summed up in buckets; only the distinct values of the buckets that hold a
    percentile are ordered, bucket by bucket, so a group's values never lie in one task."""
    counts = samples.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c")).withColumn("_b", bucket(F.col("_v")))
    group = Window.partitionBy(*by)
    buckets = counts.groupBy(*by, "_b").agg(F.sum("_c").alias("_m"))
    placed = buckets.withColumns({"_n": F.sum("_m").over(group), "_to": F.sum("_m").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))})
    at = {k: F.floor((F.col("_n") - 1) * a / b) for k, (a, b) in PERCENTILES.items()}
    wanted = F.array(*[F.when((F.col("_to") > p) & (F.col("_to") - F.col("_m") <= p), F.struct(F.lit(k).alias("k"), (p - F.col("_to") + F.col("_m")).alias("p"))) for k, p in at.items()])
    held = placed.withColumn("_want", F.filter(wanted, lambda x: x.isNotNull())).where(F.size("_want") > 0).select(*by, "_b", "_want")
    inside = counts.join(held, [*by, "_b"])
    inside = inside.withColumn("_to", F.sum("_c").over(Window.partitionBy(*by, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    hit = inside.select(*by, "_v", F.explode(F.filter("_want", lambda x: (F.col("_to") > x["p"]) & (F.col("_to") - F.col("_c") <= x["p"]))).alias("_w"))
    picked = hit.groupBy(*by).agg(*[F.min(F.when(F.col("_w.k") == k, F.col("_v"))).alias(k) for k in PERCENTILES])
    whole = counts.groupBy(*by).agg(F.sum("_c").alias("n"), F.sum(F.col("_v") * F.col("_c")).alias("total"), F.min("_v").alias("min"), F.max("_v").alias("max"))
    return whole.join(picked, list(by))
