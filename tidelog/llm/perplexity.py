"""Quality classifier: an interpolated modified Kneser-Ney model of UTF-8 byte 4-grams.

All texts are counted, in tasks that first add up their own grams.  Continuation counts, context sums and discounts come
from aggregations of the trusted texts' counts, and the probability of every gram of the corpus from joins of those counts
by gram and context, order upon order: nothing of the model passes through the driver.  Documents then meet the
probabilities of their grams: the ``hot`` most frequent grams of the corpus, a table of fixed size, lie in every task; what
else a document holds is added up in the task and joined by gram.  Both ways add the same whole numbers, so scores are
exact sums and don't depend on where a gram is looked up.

A document is rejected where its log-perplexity lies outside fences around the quartiles of its language (and power of
two of its length) over the whole corpus.

A null or empty text has no perplexity and is rejected; without trusted text no model exists and every other document is
kept; null languages are a group of their own; groups with fewer than ``least`` documents take their language's fences,
wider for short texts as the square root of 1000 bytes to their length, or none; equal texts get equal scores; rows with
equal ids stay apart, and are trusted if a label of their id says so; a null id is never trusted; new columns replace those
of the same name and other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import kernels as K

ORDER = 4
PAD = 10  # a text begins after line feeds


#: Parts of a nat in which -log p is counted.
UNIT = 1 << 20
DIGITS = 4  # of a log-perplexity whose quartiles are taken


@dataclass(frozen=True)
class Rule:
    """low, high: quartile distances below and above the quartiles; least: documents of a group with own fences; hot: grams
    that tasks hold; ids: trusted ids that may be broadcast."""

    low: float = 4.0
    high: float = 4.0
    floor: float = 0.01
    least: int = 30
    hot: int = 1 << 18
    ids: int = 2_000_000


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with ORDER - 1 line feeds before each row, and the places of the rows' own bytes."""
    n = ORDER - 1
    flat = np.insert(data, np.repeat(offsets[:-1], n), PAD)
    own = np.arange(len(data)) + np.repeat(n * np.arange(1, len(offsets)), np.diff(offsets))
    return flat, own


def grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    flat, at = padded(data, offsets)
    flat = flat.astype(np.uint32)
    out = np.zeros(len(at), np.uint32)
    for k in range(ORDER):
        out = out << np.uint32(8) | flat[at - (ORDER - 1 - k)]
    return out


def added(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(g, kind="stable")
    g, c = g[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    return g[first], np.add.reduceat(c, first) if len(first) else c


def count(texts: DataFrame, text: str = "text", trusted: str = "trusted") -> DataFrame:
    """g, c, n: every 4-gram, and its count in the trusted texts and in all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {"c": [], "n": []}
        size = 0
        for batch in batches:
            good = np.asarray(batch.column(1).fill_null(False))
            for a, b, data, offsets in K.chunks(batch.column(0)):
                g = grams(data, offsets)
                mine = g[np.repeat(good[a:b], np.diff(offsets))]
                for k, x in (("c", mine), ("n", g)):
                    held[k].append(np.unique(x, return_counts=True))
                    size += len(held[k][-1][0])
                if size > 2_000_000:
                    held = {k: [added(*map(np.concatenate, zip(*v)))] for k, v in held.items()}
                    size = sum(len(v[0][0]) for v in held.values())
                    if size > 1_000_000:
                        yield from rows(held)
                        held, size = {"c": [], "n": []}, 0
        yield from rows(held)
        K.release()

    def rows(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        if held["n"]:
            (g, n), (mine, c) = (added(*map(np.concatenate, zip(*held[k]))) for k in ("n", "c"))
            both = np.zeros(len(g), np.int64)
            both[np.searchsorted(g, mine)] = c
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int64)), pa.array(both), pa.array(n.astype(np.int64))], names=["g", "c", "n"])

    found = frames.in_batches(texts).select(text, F.col(trusted).cast("boolean")).mapInArrow(run, "g bigint, c bigint, n bigint")
    return found.groupBy("g").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def smoothed(counted: DataFrame) -> DataFrame:
    """order, g, hit (discounted share of its context), back (weight of the lower order), total (of the context)."""
    levels = counted.select(F.lit(ORDER).alias("order"), "g", "c")
    below = counted
    for order in range(ORDER - 1, 0, -1):  # below the top, c is the number of grams one longer that end so
        below = below.groupBy(F.col("g").bitwiseAND((1 << 8 * order) - 1).alias("g")).agg(F.count("*").alias("c"))
        levels = levels.unionByName(below.select(F.lit(order).alias("order"), "g", "c"))
    levels = frames.written(levels)
    n = [F.sum(F.when(F.col("c") == k, 1).otherwise(0)).cast("double") for k in (1, 2, 3, 4)]
    tally = levels.groupBy("order").agg(*[x.alias(f"n{k}") for k, x in enumerate(n, 1)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    ok = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    cut = [F.when(ok, F.greatest(F.lit(0.1), F.lit(float(k)) - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}"))).otherwise(F.lit(k / 2)) for k in (1, 2, 3)]
    cuts = tally.select("order", *[c.alias(f"d{k}") for k, c in enumerate(cut, 1)])
    context = F.shiftright("g", 8)
    kinds = [F.sum(F.when(x, 1).otherwise(0)).alias(f"k{k}") for k, x in enumerate((F.col("c") == 1, F.col("c") == 2, F.col("c") >= 3), 1)]
    sums = levels.groupBy("order", context.alias("x")).agg(F.sum("c").alias("total"), *kinds)
    joined = levels.withColumn("x", context).join(sums, ["order", "x"]).join(F.broadcast(cuts), "order")  # cuts: a row for each order
    d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
    hit = F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("total")
    back = (F.col("d1") * F.col("k1") + F.col("d2") * F.col("k2") + F.col("d3") * F.col("k3")) / F.col("total")
    return joined.select("order", "g", hit.alias("hit"), back.alias("back"), "total")


def weighed(counted: DataFrame, levels: DataFrame) -> DataFrame:
    """g, n, w of every gram of ``counted``: its count and -log p of its last byte after the others, in UNITs.

    From the lowest order up: p(gram) = hit(gram) + back(context) * p(gram without its first byte), where hit is 0 for a gram
    that trusted texts lack, and back is 1 for a context that they lack."""
    asked = {ORDER: counted.select("g")}
    for order in range(ORDER - 1, 0, -1):
        asked[order] = asked[order + 1].select(F.col("g").bitwiseAND((1 << 8 * order) - 1).alias("g")).distinct()
    below = None
    for order in range(1, ORDER + 1):
        level = levels.where(F.col("order") == order)
        backs = level.groupBy(F.shiftright("g", 8).alias("x")).agg(F.max("back").alias("back"))
        mine = asked[order].join(level.select("g", "hit"), "g", "left").withColumn("x", F.shiftright("g", 8)).join(backs, "x", "left")
        if below is None:
            mine = mine.withColumn("low", F.lit(1 / 256))
        else:
            mine = mine.withColumn("s", F.col("g").bitwiseAND((1 << 8 * (order - 1)) - 1)).join(below.select(F.col("g").alias("s"), F.col("p").alias("low")), "s")
        below = mine.select("g", (F.coalesce("hit", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * F.col("low")).alias("p"))
        if order < ORDER:
            below = frames.written(below)
    return counted.select("g", "n").join(below, "g").select("g", "n", F.round(-F.log(F.greatest("p", F.lit(1e-12))) * UNIT).cast("long").alias("w"))


@dataclass(frozen=True)
class Model:
    """g, w: the hot grams and their weights; cold: a table g, w of all others, or None if there are none."""

    g: np.ndarray
    w: np.ndarray
    cold: DataFrame | None = None


class Lookup:
    """Weights of hot grams by place: rows[index[context], column of the byte], -1 for those that aren't hot."""

    def __init__(self, g: np.ndarray, w: np.ndarray):
        parts = [g >> 8 * k & 255 for k in (3, 2, 1, 0)]
        seen = np.unique(np.concatenate([*parts, [PAD]]))
        self.width = len(seen) + 1
        self.column = np.full(256, self.width - 1, np.int64)  # bytes of no hot gram share a column
        self.column[seen] = np.arange(self.width - 1)
        context = self._context(*(self.column[p] for p in parts[:3]))
        names, row = np.unique(context, return_inverse=True)
        self.index = np.zeros(self.width**3, np.int32)
        self.index[names] = np.arange(1, len(names) + 1)
        self.rows = np.full((len(names) + 1, self.width), -1, np.int32)
        self.rows[row + 1, self.column[parts[3]]] = w

    def _context(self, a, b, c):
        return (a * self.width + b) * self.width + c

    def weights(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        flat, at = padded(data, offsets)
        flat = self.column[flat]
        return self.rows[self.index[self._context(flat[at - 3], flat[at - 2], flat[at - 1])], flat[at]].astype(np.int64)


def flagged(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` with trusted: whether a label says that the document is of good quality."""
    ids = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct().withColumn("trusted", F.lit(True))
    good = F.broadcast(ids) if frames.small_enough(ids, rule.ids) else ids
    return docs.drop("trusted").join(good, "doc_id", "left")


def trained(texts: DataFrame, rule: Rule = Rule()) -> Model | None:
    """The model of the trusted texts, with a weight for every gram of ``texts`` (text, trusted)."""
    counted = frames.written(count(texts))
    good = counted.where("c > 0").select("g", "c")
    if good.isEmpty():
        return None
    grams_ = frames.written(weighed(counted, smoothed(good)))
    hot = grams_.orderBy(F.desc("n"), "g").limit(rule.hot).toPandas()  # of fixed size
    cold = None
    if len(hot) == rule.hot:
        last = hot.iloc[-1]
        cold = grams_.where((F.col("n") < int(last.n)) | (F.col("n") == int(last.n)) & (F.col("g") > int(last.g))).select("g", "w")
        cold = None if cold.isEmpty() else cold
    return Model(hot.g.to_numpy(np.int64), hot.w.to_numpy(np.int64), cold)


def score(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id", "lang"), text: str = "text") -> DataFrame:
    """``keep`` with n_bytes and log_perplexity (nats a byte; null for no bytes or no model), written.  ``docs`` must be
    among the texts that the model was trained on."""
    held = docs.sparkSession.sparkContext.broadcast(None if model is None else (model.g, model.w))

    def make():
        own = None if held.value is None else Lookup(*held.value)

        def f(data, offsets, rows):
            size, n = np.diff(offsets), len(offsets) - 1
            if own is None:
                return [size, pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.list_(pa.int64()))] * 2]
            w = own.weights(data, offsets)
            at = np.flatnonzero(w < 0)
            row = np.searchsorted(offsets, at, "right") - 1
            # each row's other grams, once, with their count
            key, c = np.unique(row.astype(np.uint64) << np.uint64(32) | grams(data, offsets)[at], return_counts=True)
            ends = pa.array(np.searchsorted(key >> np.uint64(32), np.arange(n + 1, dtype=np.uint64)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int64))) for x in (key & np.uint64(0xFFFFFFFF), c)]
            return [size, K.per_row(np.maximum(w, 0), offsets), *lists]

        return f

    scored = frames.map_text(docs, make, "n_bytes bigint, _w bigint, _g array<bigint>, _c array<bigint>", keep, text)
    total = F.col("_w")
    if model is not None and model.cold is not None:
        # written with the numbers of its rows, so that they stay the same
        scored = frames.written(scored.withColumn("_row", F.monotonically_increasing_id()))
        missed = scored.select("_row", F.explode(F.arrays_zip("_g", "_c")).alias("z")).select("_row", F.col("z._g").alias("g"), F.col("z._c").alias("c"))
        more = missed.join(model.cold, "g").groupBy("_row").agg(F.sum(F.col("c") * F.col("w")).alias("_more"))
        scored = scored.drop("_g", "_c").join(more, "_row", "left")
        total = total + F.coalesce("_more", F.lit(0))
    mean = total / F.lit(float(UNIT)) / F.col("n_bytes")
    return frames.written(scored.select(*keep, "n_bytes", F.when(F.col("n_bytes") > 0, mean).alias("log_perplexity")))


def judge(scored: DataFrame, lang: str = "lang", rule: Rule = Rule()) -> DataFrame:
    """``scored`` (read three times) with kept and the fences low and high."""
    group, power = F.coalesce(F.col(lang), F.lit("")), F.length(F.bin("n_bytes"))

    def quartiles(**keys: F.Column) -> DataFrame:
        # exact and the same in every run; rounded, a group has a bounded number of values
        q = F.percentile(F.round("log_perplexity", DIGITS), [0.25, 0.75])
        out = scored.where("log_perplexity is not null").groupBy(*[v.alias(k) for k, v in keys.items()]).agg(F.count("*").alias("_n"), q.alias("_q"))
        return out.where(F.col("_n") >= rule.least).drop("_n")

    by_lang = quartiles(_g=group).withColumnRenamed("_q", "_any")
    out = scored.drop("low", "high", "kept").withColumns({"_g": group, "_k": power})
    out = frames.join_small(frames.join_small(out, by_lang, ["_g"]), quartiles(_g=group, _k=power), ["_g", "_k"])
    out = out.withColumn("_wide", F.when(F.col("_q").isNull(), F.sqrt(F.greatest(F.lit(1.0), 1000 / F.greatest("n_bytes", F.lit(1))))).otherwise(1.0))
    out = out.withColumn("_q", F.coalesce("_q", "_any"))
    out = out.withColumn("_wide", F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(rule.floor)) * F.col("_wide"))
    out = out.withColumns({"low": F.col("_q")[0] - F.col("_wide") * rule.low, "high": F.col("_q")[1] + F.col("_wide") * rule.high})
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(True)) & (F.col("n_bytes") > 0)
    return out.withColumn("kept", inside).drop("_g", "_k", "_q", "_any", "_wide")


def verdicts(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_bytes, perplexity (of a byte), the fences and kept."""
    scored = score(docs, trained(flagged(docs.select("doc_id", "text"), labels, rule), rule))
    return judge(scored, rule=rule).select("doc_id", "n_bytes", F.exp("log_perplexity").alias("perplexity"), F.exp("low").alias("low"), F.exp("high").alias("high"), "kept")


def keep(docs: DataFrame, labels: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """The documents that are kept, as they were."""
    marked = docs.select("doc_id", "lang", "text", frames.same_text().alias("_same"))
    scored = score(marked, trained(flagged(docs.select("doc_id", "text"), labels, rule), rule), ("doc_id", "lang", "_same"))
    return frames.without(docs, judge(scored, rule=rule).where("not kept"))


def _sql() -> str:
    """The same verdicts for DuckDB, over grams as hexadecimal digits; rounded as the registered query's."""
    ctes = [
        "ids AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL)",
        """texts AS MATERIALIZED (
  SELECT row_number() OVER () AS r, d.doc_id, coalesce(lang, '') AS lang, ids.doc_id IS NOT NULL AS trusted, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes,
         regexp_extract_all('0A0A0A' || hex(encode(coalesce(text, ''))), '..') AS b
  FROM documents d LEFT JOIN ids ON ids.doc_id = d.doc_id)""",
        """placed AS (SELECT r, trusted, unnest(b[1:n_bytes]) AS b1, unnest(b[2:n_bytes + 1]) AS b2, unnest(b[3:n_bytes + 2]) AS b3, unnest(b[4:n_bytes + 3]) AS b4
  FROM texts WHERE n_bytes > 0)""",
        "own AS MATERIALIZED (SELECT r, trusted, b1 || b2 || b3 || b4 AS g, count(*) AS n FROM placed GROUP BY ALL)",
        "c4 AS MATERIALIZED (SELECT g, sum(n)::BIGINT AS c FROM own WHERE trusted GROUP BY 1)",
        "a4 AS MATERIALIZED (SELECT DISTINCT g FROM own)",
    ]
    for k in range(ORDER - 1, 0, -1):
        ctes += [f"c{k} AS MATERIALIZED (SELECT substr(g, 3) AS g, count(*) AS c FROM c{k + 1} GROUP BY 1)", f"a{k} AS MATERIALIZED (SELECT DISTINCT substr(g, 3) AS g FROM a{k + 1})"]
    for k in range(1, ORDER + 1):
        n = ", ".join(f"count(*) FILTER (c = {j})::DOUBLE AS n{j}" for j in (1, 2, 3, 4))
        cut = ", ".join(f"CASE WHEN least(n1, n2, n3) > 0 THEN greatest(0.1::DOUBLE, {j}::DOUBLE - y * {j + 1} * n{j + 1} / n{j}) ELSE {j / 2}::DOUBLE END AS d{j}" for j in (1, 2, 3))
        low = "1::DOUBLE / 256" if k == 1 else "low.p"
        lower = "" if k == 1 else f" JOIN p{k - 1} low ON low.g = substr(a.g, 3)"
        ctes += [
            f"t{k} AS (SELECT *, n1 / (n1 + 2 * n2) AS y FROM (SELECT {n} FROM c{k}))",
            f"d{k} AS MATERIALIZED (SELECT {cut} FROM t{k})",
            f"""x{k} AS MATERIALIZED (SELECT x, total, (d1 * k1 + d2 * k2 + d3 * k3) / total AS back FROM d{k}, (
  SELECT left(g, {2 * k - 2}) AS x, sum(c)::DOUBLE AS total, count(*) FILTER (c = 1) AS k1, count(*) FILTER (c = 2) AS k2, count(*) FILTER (c > 2) AS k3 FROM c{k} GROUP BY 1))""",
            f"""p{k} AS MATERIALIZED (
  SELECT a.g, coalesce(greatest(c - CASE WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END, 0::DOUBLE) / total, 0::DOUBLE) + coalesce(back, 1::DOUBLE) * {low} AS p
  FROM a{k} a CROSS JOIN d{k} LEFT JOIN c{k} c ON c.g = a.g LEFT JOIN x{k} x ON x.x = left(a.g, {2 * k - 2}){lower})""",
        ]
    rule = Rule()
    return "WITH " + ",\n".join(ctes) + f""",
weights AS MATERIALIZED (SELECT g, round(-ln(greatest(p, 1e-12::DOUBLE)) * {UNIT})::BIGINT AS w FROM p{ORDER}),
sums AS (SELECT r, sum(n * w)::DOUBLE AS total FROM own JOIN weights USING (g) WHERE (SELECT count(*) FROM c{ORDER}) > 0 GROUP BY 1),
scored AS MATERIALIZED (SELECT doc_id, lang, n_bytes, length(bin(n_bytes)) AS power, total / {UNIT} / n_bytes AS lp FROM texts LEFT JOIN sums USING (r)),
by_lang AS (SELECT lang, quantile_cont(round(lp, {DIGITS}), [0.25, 0.75]) AS q FROM scored WHERE lp IS NOT NULL GROUP BY 1 HAVING count(*) >= {rule.least}),
by_both AS (SELECT lang, power, quantile_cont(round(lp, {DIGITS}), [0.25, 0.75]) AS q FROM scored WHERE lp IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= {rule.least}),
spread AS (
  SELECT doc_id, n_bytes, lp, coalesce(b.q, l.q) AS q,
         CASE WHEN b.q IS NULL THEN sqrt(greatest(1::DOUBLE, 1000::DOUBLE / greatest(n_bytes, 1))) ELSE 1::DOUBLE END AS wide
  FROM scored s LEFT JOIN by_lang l ON l.lang = s.lang LEFT JOIN by_both b ON b.lang = s.lang AND b.power = s.power),
fenced AS (
  SELECT doc_id, n_bytes, lp, q[1] - greatest(q[2] - q[1], {rule.floor}::DOUBLE) * wide * {rule.low} AS low, q[2] + greatest(q[2] - q[1], {rule.floor}::DOUBLE) * wide * {rule.high} AS high FROM spread)
SELECT doc_id, n_bytes, round(exp(lp), 6) AS perplexity, round(exp(low), 6) AS low, round(exp(high), 6) AS high,
       coalesce(lp BETWEEN low AND high, true) AND n_bytes > 0 AS kept FROM fenced
"""


SQL = _sql()
