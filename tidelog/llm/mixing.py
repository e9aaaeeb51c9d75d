"""Mixing sources to target weights by capped water-filling.

Each source asks for its weight's share of all sizes, but gives ``most`` times its own size at the most; what it can't
give is shared among the others by weight until none is above.  With the sources ordered by how soon they reach their
cap (cap / weight), the capped ones are those whose cap lies below the level that the rest would have, so the level
comes from running sums and needs no rounds.

A source's texts are then repeated whole ``floor(target / size)`` times, and a seeded choice of them once more: in order
of size (in steps of 3 %) and a seeded hash, every 1/fraction-th text.  Picked texts so have the sizes of all texts, and
the words taken come within about one text of the target; the one text that brings them nearest, by its size, is then
taken once more or once less.  Ranks come from counts of (source, size step, slice of the hash) and a row number within,
with slices enough for the rows there are, so no source or size lands in one task.

Null source is a source of its own and the last; null or empty text has size 0 and is never taken beyond 0 words; rows
with equal ids are placed apart; an empty table gives an empty result.  Result columns replace those of the same name.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import join_small, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, MOST, SEED = (1, 2, 3), 3, 17
SLICE_ROWS = 20_000  # of one slice of the hash, on average over all rows


def n_words(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (_s, _none, source_size: a row for each source) with target."""
    order = Window.orderBy("_none", "_s")
    n = len(weights)
    ranked = sizes.withColumn("_w", F.array(*map(F.lit, weights))[(F.row_number().over(order) - 1) % n].cast("long"))
    ranked = ranked.withColumns({"_all": F.sum("source_size").over(Window.partitionBy()), "_ratio": (most * F.col("source_size")).cast("double") / F.col("_w")})
    by_ratio = Window.orderBy("_ratio", "_none", "_s")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0))).cast("double") / F.sum("_w").over(rest)
    marked = ranked.withColumn("_capped", F.col("_ratio") <= level)
    whole = Window.partitionBy()
    marked = marked.withColumns({
        "_left": F.col("_all") - F.sum(F.when(F.col("_capped"), most * F.col("source_size")).otherwise(0)).over(whole),
        "_free": F.sum(F.when(F.col("_capped"), 0).otherwise(F.col("_w"))).over(whole),
    })
    target = F.when(F.col("_capped"), (most * F.col("source_size")).cast("double")).otherwise(F.col("_left").cast("double") / F.col("_free") * F.col("_w"))
    return marked.select("_s", "_none", "source_size", target.alias("target"))


def mix(docs: DataFrame, source: str = "source", size: str = "size", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """``docs`` (counted, then read twice) with source_size, target, times and taken (size times ``times``), from a written
    table."""
    columns = [c for c in docs.columns if c not in ("source_size", "target", "times", "taken")]
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    digits = max(2, math.ceil(math.log(max(1, docs.count() / SLICE_ROWS), 16)))
    bits = F.length(F.bin(size))
    step = F.when(bits <= 6, F.col(size)).otherwise(bits * 64 + F.expr(f"shiftright(`{size}`, length(bin(`{size}`)) - 6)"))
    keyed = docs.select(*columns).withColumns({
        "_s": F.coalesce(F.col(source), F.lit("")), "_none": F.col(source).isNull(), "_step": step.cast("long"), "_hash": F.coalesce(hashed, F.lit("")),
    }).withColumn("_slice", F.substring("_hash", 1, digits))
    at = ["_s", "_none", "_step", "_slice"]
    counts = keyed.groupBy(*at).agg(F.count("*").alias("_n"), F.sum(size).alias("_size"))
    slices = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*at[:3]).orderBy("_slice")) - F.col("_n"))
    steps = counts.groupBy(*at[:3]).agg(F.sum("_n").alias("_m"))
    steps = steps.withColumn("_below", F.sum("_m").over(Window.partitionBy(*at[:2]).orderBy("_step")) - F.col("_m")).drop("_m")
    wanted = targets(counts.groupBy(*at[:2]).agg(F.sum("_size").alias("source_size")), weights, most)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("_s"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    places = join_small(slices.drop("_n", "_size").join(steps, at[:3]), wanted, at[:2], "inner")
    places = places.select(*at, (F.col("_before") + F.col("_below")).alias("_offset"), "source_size", "target", start.alias("_start"))
    ranked = keyed.withColumn("_row", F.row_number().over(Window.partitionBy(*at).orderBy("_hash", key, size)))
    out = ranked.join(places, at).withColumn("_rank", F.col("_offset") + F.col("_row"))
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = out.withColumn("_epochs", epochs).withColumn("_part", F.col("_epochs") - F.floor("_epochs"))
    once_more = F.floor(F.col("_rank") * F.col("_part") + F.col("_start")) - F.floor((F.col("_rank") - 1) * F.col("_part") + F.col("_start"))
    out = out.withColumn("times", (F.floor("_epochs") + once_more).cast("long"))
    out = nearest(written(out.select(*columns, "_s", "_none", "_rank", "source_size", "target", "times")), size, most)
    return out.select(*columns, "source_size", "target", "times", (F.col(size) * F.col("times")).alias("taken"))


def nearest(out: DataFrame, size: str = "size", most: int = MOST) -> DataFrame:
    """``out`` (read three times; _rank tells a source's rows apart) with the times of one row of each source changed by one,
    where that brings the source nearer to its target."""
    of = ["_s", "_none"]
    short = out.groupBy(*of).agg((F.max("target") - F.sum(F.col(size) * F.col("times"))).alias("_short"))
    off = F.abs(F.abs("_short") - F.col(size))
    able = ((F.col("_short") > 0) & (F.col("times") < most)) | ((F.col("_short") < 0) & (F.col("times") > 0))
    asked = join_small(out.select(*of, "_rank", size, "times"), short, of, "inner").where(able & (off < F.abs("_short")))
    best = asked.groupBy(*of).agg(F.min(F.struct(off.alias("off"), "_rank")).alias("_best"), F.max(F.signum("_short")).alias("_step"))
    changed = join_small(out, best.select(*of, F.col("_best._rank").alias("_pick"), F.col("_step").cast("long").alias("_step")), of)
    return changed.withColumn("times", F.col("times") + F.when(F.col("_rank") == F.col("_pick"), F.col("_step")).otherwise(0)).drop("_pick", "_step")


def repeat(docs: DataFrame) -> DataFrame:
    """``docs`` as mixed: each row as often as the mix takes it."""
    columns = docs.columns
    mine = docs.select(*[F.col(f"`{c}`").alias(f"_in{i}") for i, c in enumerate(columns)], F.col("doc_id").alias("_id"), F.col("source").alias("_source"), n_words().alias("_size"))
    mixed = mix(mine, "_source", "_size", "_id").where("times > 0")
    copies = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return copies.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(columns)])


#: The same mix for DuckDB.
SQL = rf"""
WITH sized AS (
  SELECT doc_id, coalesce(source, '') AS s, source IS NULL AS none,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size, md5('{SEED}:' || doc_id::VARCHAR) AS h
  FROM documents),
sources AS (SELECT s, none, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1, 2),
weighed AS (
  SELECT *, [1, 2, 3][((row_number() OVER (ORDER BY none, s)) - 1) % 3 + 1]::BIGINT AS w,
         sum(source_size) OVER ()::BIGINT AS everything FROM sources),
rated AS (SELECT *, (3 * source_size)::DOUBLE / w AS ratio FROM weighed),
levelled AS (
  SELECT *, (everything - coalesce(sum(3 * source_size) OVER (ORDER BY ratio, none, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER (ORDER BY ratio, none, s ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM rated),
shared AS (
  SELECT *, (everything - sum(CASE WHEN ratio <= level THEN 3 * source_size ELSE 0 END) OVER ())::DOUBLE AS remaining,
         (sum(CASE WHEN ratio <= level THEN 0 ELSE w END) OVER ())::DOUBLE AS free FROM levelled),
targets AS (
  SELECT s, none, source_size,
         CASE WHEN ratio <= level THEN (3 * source_size)::DOUBLE ELSE remaining / free * w END AS target,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE
           (CASE WHEN ratio <= level THEN (3 * source_size)::DOUBLE ELSE remaining / free * w END) / source_size END AS epochs,
         ('0x' || substr(md5('{SEED}/' || s), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS start FROM shared),
stepped AS (
  SELECT *, CASE WHEN length(bin(size)) <= 6 THEN size ELSE length(bin(size)) * 64 + (size >> (length(bin(size)) - 6)) END AS step FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s, none ORDER BY step, h, doc_id, size) AS place FROM stepped),
picked AS (
  SELECT s, none, place, doc_id, size, source_size, target,
         (floor(epochs) + floor(place * (epochs - floor(epochs)) + start) - floor((place - 1) * (epochs - floor(epochs)) + start))::BIGINT AS times
  FROM ranked JOIN targets USING (s, none)),
lacking AS (SELECT s, none, max(target) - sum(size * times)::DOUBLE AS short FROM picked GROUP BY 1, 2),
best AS (
  SELECT s, none, place, sign(short)::BIGINT AS more FROM picked JOIN lacking USING (s, none)
  WHERE (short > 0 AND times < 3 OR short < 0 AND times > 0) AND abs(abs(short) - size) < abs(short)
  QUALIFY row_number() OVER (PARTITION BY s, none ORDER BY abs(abs(short) - size), place) = 1),
mixed AS (SELECT p.* EXCLUDE (times), p.times + coalesce(more, 0) AS times FROM picked p LEFT JOIN best USING (s, none, place))
SELECT doc_id, size, source_size, target, size * times AS taken, times FROM mixed
"""
