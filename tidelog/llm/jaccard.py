"""Exact n-gram Jaccard join by position-blocked prefix lists, with answers derived from similar sets' answers.

A text's set is its distinct shingles (64-bit hashes).  Texts with the same words form one class, told apart by 128 bits
of hash; one member stands for it.  Two classes link when their sets' Jaccard similarity reaches ``percent``; the result
is each text's component.

*Index lists.*  All sets are ordered alike: first shingles known to be rare, then known frequent ones, each by hash; only
a set's first n - ceil(n * percent / 100) + 1 shingles, where any partner must share one, are listed.  What is frequent
comes from an exact count of the shingles that can be in a list, and reaches the tasks as bits of fixed size: it steers
the order only, so a bit set in error costs time and never a link.

*Skipping by position.*  A list is kept in blocks of places, by size within a block.  For an entry of n shingles at place
i, partners in a block whose least place is j must have ((100 + percent) * j + percent * n) / 100 to
(100 * n - (100 + percent) * i) / percent shingles: two searches in a block give its run of possible partners, and a block
without one, or what lies outside of the run, is stepped over unread.

*Answers from similar sets.*  Short lists give their pairs directly.  A long list first gives each entry's pairs with a
few pivots, the sets with the fewest shingles of their own: they lie in the middle of a family of near copies, and are the
same ones in all of its lists.  Sketches of 128 bytes rule out pairs that differ too much.  Verified links join classes
into components; pairs within a component need no answer, in short lists and long ones.  For pairs across components each
class has a parent, the linked set that it shares most with.  The overlap of two parents is computed once, and
overlap(a, b) lies between overlap(p, q) - |p - a| - |q - b| and overlap(p, q) + |a - p| + |b - q|: most pairs' answers
follow from that, and only the others' sets are read.  So a family of k near copies costs about k verifications, and no
link between components is lost.

Texts without words (null, empty, blank) have no shingles and are components of their own.  A text of fewer words than
``width`` has one shingle of all its words.  Rows of one id stay apart, whatever their texts; a null id counts as none
when the smallest id of a component is taken.  Columns of any other name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames
from . import kernels as K
from .components import components


@dataclass(frozen=True)
class Rule:
    """width: words a shingle; percent: least similarity; long: entries beyond which a list is long; bits: of the table of
    frequent shingles; share: of the hash range in which all shingles are counted; pivots: of a long list in the first
    round; salts: parts that lists are dealt to in joins."""

    width: int = 5
    percent: int = 80
    long: int = 32
    bits: int = 1 << 24
    share: float = 0.3
    pivots: int = 3
    salts: int = 16


def prefix(n, percent: int):
    return n - (n * percent + 99) // 100 + 1


def sets(data: np.ndarray, offsets: np.ndarray, width: int, twins: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class of each row and the other half of its hash, and row and hash of every distinct shingle, ordered by both.

    ``twins``: classes whose name fits several texts; these take both halves for a name."""
    n = len(offsets) - 1
    start, end, row = K.words(data, offsets)
    hashes = K.word_hashes(data, start, end, True)
    classes, other = K.sequence_hashes(data, offsets, row, end)
    if twins is not None and len(twins):
        twin = np.isin(classes.view(np.int64), twins)
        classes[twin] = K.windows(np.stack([classes[twin], other[twin]], 1).ravel(), 2 * np.arange(int(twin.sum())), 2)
    at, h = K.distinct(*K.shingles(hashes, row, n, width))
    return classes.view(np.int64), other, at, h


def members(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", twins: np.ndarray | None = None) -> DataFrame:
    """key, same (a hash of the text as it is), cls, other, n_shingles of every row; cls is null without words.  ``listed``:
    of the first row of each class in a task, the shingles that a list may hold."""
    limit = np.uint64(int(rule.share * 2**64))
    rows = docs.select(F.col(key).alias("key"), frames.same_text(text).alias("same"), F.col(text).alias("text"))

    def make():
        seen: set[int] = set()

        def f(data, offsets, _):
            classes, other, at, h = sets(data, offsets, rule.width, twins)
            n = np.bincount(at, minlength=len(classes))
            new = np.zeros(len(classes), bool)
            for k in np.flatnonzero(n).tolist():
                if (c := int(classes[k])) not in seen:
                    seen.add(c)
                    new[k] = True
            take = new[at] & ((h < limit) | (_ranks(at) < prefix(n, rule.percent)[at]))
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(at[take], minlength=len(classes)))]).astype(np.int32), mask=np.append(~new, False))
            return [pa.array(classes, mask=n == 0), other.view(np.int64), n, pa.ListArray.from_arrays(ends, pa.array(h[take].view(np.int64)))]

        return f

    return frames.map_text(rows, make, "cls bigint, other bigint, n_shingles bigint, listed array<bigint>", ("key", "same"))


def _by_class(docs: DataFrame, text: str, rule: Rule, twins: np.ndarray | None, fields: str, emit) -> DataFrame:
    """What ``emit(classes, sizes, row, hashes)`` gives for the first row of each class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch.column(0)):
                classes, _, row, h = sets(data, offsets, rule.width, twins)
                n = np.bincount(row, minlength=len(classes))
                new = np.zeros(len(classes), bool)
                for k in np.flatnonzero(n).tolist():
                    if (c := int(classes[k])) not in seen:
                        seen.add(c)
                        new[k] = True
                keep = new[row]
                made = emit(classes, n, row[keep], h[keep])
                if made is not None:
                    yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in made], names=[f.split()[0] for f in fields.split(", ")])
        K.release()

    return frames.in_batches(docs).select(text).mapInArrow(run, fields)


def _ranks(row: np.ndarray) -> np.ndarray:
    """Each entry's place within its row; rows ascend."""
    first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return np.arange(len(row)) - np.repeat(at, np.diff(np.append(at, len(row))))


def _slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (h.astype(np.uint64) >> np.uint64(8)) & np.uint64(bits - 1)


def bitmap(values: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bits of the hashes in ``column``: at most bits / 64 rows reach the driver."""
    slot = F.shiftrightunsigned(F.col(column), 8).bitwiseAND(bits - 1)
    packed = values.groupBy(F.shiftright(slot, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((shiftrightunsigned({column}, 8) & 63) as int))")).alias("b")).toPandas()
    out = np.zeros(bits // 64, np.uint64)
    out[packed.w.to_numpy(np.int64)] = packed.b.to_numpy(np.int64).view(np.uint64)
    return out


def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = _slots(h, len(bits) * 64)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def frequent(base: DataFrame, rule: Rule) -> np.ndarray:
    """Bits of the shingles of long lists; where these would fill more than an eighth of the bits, of the longest."""
    counts = base.select(F.explode("listed").alias("t")).groupBy("t").agg(F.count("*").alias("c")).where(F.col("c") > rule.long)
    counts = frames.written(counts)
    tally = {r.p: r.n for r in counts.groupBy(F.length(F.bin("c")).alias("p")).agg(F.count("*").alias("n")).collect()}  # a row a power
    least, power = rule.long, rule.long.bit_length()
    while sum(n for p, n in tally.items() if p >= power) > rule.bits // 8:
        power += 1
        least = (1 << power - 1) - 1
    out = bitmap(counts.where(F.col("c") > least), "t", rule.bits)
    frames.discard(counts)
    return out


def listed(base: DataFrame, rule: Rule, bits, long: bool) -> DataFrame:
    """Entries t, cls, n, place of the long or the short lists; ``bits``: a broadcast."""
    limit = np.uint64(int(rule.share * 2**64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            step = max(1, int(batch.num_rows * (1 << 18) / max(1, len(column.flatten()))))  # rows of about 2 MB
            for k in range(0, batch.num_rows, step):
                classes, n, part = (np.asarray(batch.column(0)[k : k + step]), np.asarray(batch.column(1)[k : k + step]), column[k : k + step])
                h = np.asarray(part.flatten()).view(np.uint64)
                row = np.repeat(np.arange(len(n)), np.asarray(part.value_lengths()))
                known = has(bits.value, h)
                kind = np.where(h >= limit, 2, known)  # h ascends in a row, so that a stable sort by kind keeps its order
                order = np.argsort(row * 3 + kind, kind="stable")
                row, h, known = row[order], h[order], known[order]
                place = _ranks(row)
                take = (place < prefix(n, rule.percent)[row]) & (known == long)
                made = (h[take].view(np.int64), classes[row[take]], n[row[take]].astype(np.int32), place[take].astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], names=["t", "cls", "n", "place"])

    return frames.in_batches(base).where("listed is not null").select("cls", "n_shingles", "listed").mapInArrow(run, "t bigint, cls bigint, n int, place int")


BITS = 1024  # of a sketch


def parities(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    """BITS bits of each row (rows from 0, without gaps): whether an odd number of its hashes falls on each.

    Two sets differ by at least as many hashes as their bits do."""
    slot = row * BITS + ((h >> np.uint64(20)) & np.uint64(BITS - 1)).astype(np.int64)
    odd = (np.bincount(slot, minlength=BITS * (int(row[-1]) + 1)) & 1).astype(bool)
    return np.packbits(odd.reshape(-1, BITS), axis=1).view(np.int64)


def possible(n, i, m, j, percent: int):
    """Whether sets of n <= m shingles can link over entries at places i and j, their first common shingle."""
    need = -(-(percent * (n + m)) // (100 + percent))
    return (100 * n >= percent * m) & (1 + np.minimum(n - i - 1, m - j - 1) >= need)


def block(place: np.ndarray) -> np.ndarray:
    """The block of a place: 0 to 3 alone, then four blocks to each power of two."""
    place = np.asarray(place, np.int64)
    power = np.maximum(np.frexp(place.astype(float))[1] - 1, 2)
    return np.where(place < 4, place, 4 * (power - 1) + (place >> power - 2) - 4)


def partners(n, i, j, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest size of a partner, at places from j on, of sets of n shingles at places i."""
    return -(-((100 + percent) * j + percent * n) // 100), (100 * n - (100 + percent) * i) // percent


def pairs_of_blocks(t, cls, n, place, percent: int) -> list[np.ndarray]:
    """Positions x and y of all entries of one list that could link, each pair once.

    Entries come ordered by t, block and n; partners of the own block follow the entry, others are of later blocks."""
    n, place, blocks = n.astype(np.int64), place.astype(np.int64), block(place)
    new_list = np.concatenate([[True], t[1:] != t[:-1]])
    new_block = new_list | np.concatenate([[True], blocks[1:] != blocks[:-1]])
    number = np.cumsum(new_block) - 1  # of each entry's block
    first = np.flatnonzero(new_block)
    least = np.minimum.reduceat(place, first)
    size = np.diff(np.append(first, len(t)))
    low, high = n[first], n[first + size - 1]
    list_of = np.cumsum(new_list)[first]
    last = np.searchsorted(list_of, list_of, "right")[number]  # block after the last of the entry's list
    found: list[tuple[np.ndarray, np.ndarray]] = []
    key = number << 32 | n  # ascends
    at, ahead = np.arange(len(t)), 0
    while len(at):
        at = at[number[at] + ahead < last[at]]
        b = number[at] + ahead
        lo, hi = partners(n[at], place[at], least[b], percent)
        lo, hi = np.maximum(lo, low[b]), np.minimum(hi, high[b])
        x, b, lo, hi = (v[lo <= hi] for v in (at, b, lo, hi))  # the others' blocks are skipped
        start = np.searchsorted(key, b << 32 | lo)
        stop = np.searchsorted(key, b << 32 | hi, "right")
        if not ahead:
            start = np.maximum(start, x + 1)
        some = stop > start
        x, start, count = x[some], start[some], (stop - start)[some]
        x = np.repeat(x, count)
        y = np.arange(len(x)) + np.repeat(start - (np.cumsum(count) - count), count)
        less = n[x] <= n[y]
        small, big = np.where(less, x, y), np.where(less, y, x)
        ok = (cls[x] != cls[y]) & possible(n[small], place[small], n[big], place[big], percent)
        found.append((x[ok], y[ok]))
        ahead += 1
    return [np.concatenate([f[k] for f in found]) for k in (0, 1)]


_PAIRS = "a bigint, b bigint, n_a int, n_b int, shared bigint"


def pairs_of_lists(entries: DataFrame, rule: Rule) -> DataFrame:
    """a, b, n_a, n_b, shared (lists of the task that gave the pair) of the short lists.

    Lists that prove to be long come out entry by entry instead: t, cls, n and place with shared -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            columns = [np.asarray(c) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns)]
            t = columns[0]
            cut = int(np.searchsorted(t, t[-1])) if len(t) else 0
            rest = [c[cut:] for c in columns]
            yield from pairs(*(c[:cut] for c in columns))
        if rest is not None:
            yield from pairs(*rest)
        K.release()

    def table(a, b, n_a, n_b, shared) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n_a.astype(np.int32)), pa.array(n_b.astype(np.int32)), pa.array(shared.astype(np.int64))], names=["a", "b", "n_a", "n_b", "shared"])

    def pairs(t, c, n, place):
        if not len(t):
            return
        bounds = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]]))
        size = np.diff(bounds)
        long = np.repeat(size > rule.long, size)
        if long.any():
            yield table(t[long], c[long], n[long], place[long], np.full(int(long.sum()), -1))
        some = np.repeat((size > 1) & (size <= rule.long), size)
        t, c, n, place = t[some], c[some], n[some], place[some]
        if not len(t):
            return
        order = np.lexsort((c, n, block(place), t))
        t, c, n, place = t[order], c[order], n[order], place[order]
        x, y = pairs_of_blocks(t, c, n, place, rule.percent)
        x, y = np.where(c[x] < c[y], x, y), np.where(c[x] < c[y], y, x)
        order = np.lexsort((c[y], c[x]))
        x, y = x[order], y[order]
        a, b = c[x], c[y]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
        yield table(a[first], b[first], n[x[first]], n[y[first]], np.diff(np.append(first, len(a))))

    # repartition() without a number of partitions leaves it to spark.sql.shuffle.partitions
    return entries.repartition("t").sortWithinPartitions("t").mapInArrow(run, _PAIRS)


def _summed(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))


def _oriented(x: str, n: str, y: str, m: str) -> list:
    less = F.col(x) < F.col(y)
    pick = lambda p, q: F.when(less, F.col(p)).otherwise(F.col(q))
    return [pick(x, y).alias("a"), pick(y, x).alias("b"), pick(n, m).alias("n_a"), pick(m, n).alias("n_b"), F.lit(1).cast("long").alias("shared")]


def _may_link(n: str, i: str, m: str, j: str, percent: int):
    low, high = F.least(n, m).cast("long"), F.greatest(n, m).cast("long")
    left = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return (100 * low >= percent * high) & ((100 + percent) * left >= percent * (low + high))


def _dealt(entries: DataFrame, rule: Rule) -> DataFrame:
    """``entries`` with a salt, so that no list lands in one task."""
    return entries.withColumn("salt", F.pmod(F.xxhash64("cls"), F.lit(rule.salts)).cast("int"))


def _to_all(rows: DataFrame, rule: Rule) -> DataFrame:
    """``rows``, a few for each list, for every salt."""
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(rule.salts - 1))))


def pivot_pairs(entries: DataFrame, rule: Rule) -> DataFrame:
    """Pairs of each entry of a long list with its pivots: the classes of earliest place, whose sets have the fewest
    shingles of their own and so lie in the middle of a family of near copies; ties by a few fixed rankings."""
    least = [F.min(F.struct("place", F.xxhash64("cls", F.lit(k)).alias("r"), F.col("cls").alias("pivot"), F.col("n").alias("m"))).alias(f"p{k}") for k in range(rule.pivots)]
    pivots = entries.groupBy("t").agg(*least)
    chosen = pivots.select("t", F.explode(F.array_distinct(F.array(*[F.col(f"p{k}") for k in range(rule.pivots)]))).alias("p")).select("t", "p.pivot", "p.m", F.col("p.place").alias("j"))
    out = _dealt(entries, rule).join(_to_all(chosen, rule), ["t", "salt"]).where((F.col("cls") != F.col("pivot")) & _may_link("n", "place", "m", "j", rule.percent))
    return _summed(out.select(*_oriented("cls", "n", "pivot", "m")))


def _close(a: str, b: str, n: str, m: str, percent: int):
    """Whether sets of n and m shingles could link by the bits in which their sketches a and b differ."""
    differ = F.lit(0).cast("long")
    for k in range(BITS // 64):
        differ = differ + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    # |x ^ y| = |x| + |y| - 2 |x & y|, and a link has |x & y| >= percent * (|x| + |y|) / (100 + percent)
    return (100 + percent) * differ <= (100 - percent) * (F.col(n) + F.col(m)).cast("long")


def cross_pairs(entries: DataFrame, labels: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """All possible pairs of long lists across components, as far as ``labels`` (node, label) joins them."""
    known = entries.join(labels, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("label", "cls"))
    known = frames.written(known.select("t", "cls", "n", "place", "comp"))
    sizes = known.groupBy("t", "comp").agg(F.count("*").alias("k"))
    main = sizes.groupBy("t").agg(F.max(F.struct("k", "comp")).alias("m"), F.count("*").alias("comps")).where("comps > 1").select("t", F.col("m.comp").alias("main"))
    mixed = _dealt(known, rule).join(_to_all(main, rule), ["t", "salt"]).join(sketches.select(F.col("c").alias("cls"), "parity"), "cls")
    names = {"cls": "x", "n": "m", "place": "j", "parity": "parity_x", "comp": "other"}
    few = _to_all(mixed.where(F.col("comp") != F.col("main")).select("t", *[F.col(a).alias(b) for a, b in names.items()]), rule)
    out = mixed.join(few, ["t", "salt"]).where(
        (F.col("comp") != F.col("other")) & ((F.col("comp") == F.col("main")) | (F.col("cls") < F.col("x")))
        & _may_link("n", "place", "m", "j", rule.percent) & _close("parity", "parity_x", "n", "m", rule.percent)
    )
    return _summed(out.select(*_oriented("cls", "n", "x", "m")))


def _of_classes(docs: DataFrame, text: str, ids: DataFrame, rule: Rule, twins, field: str, emit) -> DataFrame:
    """c and what ``emit(row, hashes)`` gives of each class in ``ids`` (c), written; rows from 0, without gaps."""
    wanted = docs.sparkSession.sparkContext.broadcast(bitmap(ids, "c", rule.bits))

    def of(classes, n, row, h):
        mine = has(wanted.value, classes.view(np.uint64)[row])
        row, h = row[mine], h[mine]
        if not len(row):
            return None
        names, at = np.unique(row, return_inverse=True)
        return [classes[names], emit(at, h)]

    found = _by_class(docs, text, rule, twins, f"c bigint, {field} array<bigint>", of)
    return frames.written(found.join(ids, "c", "left_semi").groupBy("c").agg(F.any_value(field).alias(field)))


def sketches_of(docs: DataFrame, text: str, ids: DataFrame, rule: Rule, twins: np.ndarray | None = None) -> DataFrame:
    """c, parity: sketches of the classes ``ids`` (c), of 128 bytes each."""
    return _of_classes(docs, text, ids, rule, twins, "parity", lambda at, h: pa.array(parities(at, h).tolist(), pa.list_(pa.int64())))


def sets_of(docs: DataFrame, text: str, ids: DataFrame, rule: Rule, twins: np.ndarray | None = None) -> DataFrame:
    """c, s: the sets of the classes ``ids`` (c)."""
    return _of_classes(docs, text, ids, rule, twins, "s", lambda at, h: pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(int(at[-1]) + 2)).astype(np.int32)), pa.array(h.view(np.int64))))


def close_pairs(pairs: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """The pairs that could link by their sketches."""
    of = lambda c: sketches.select(F.col("c").alias(c), F.col("parity").alias(f"p_{c}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").where(_close("p_a", "p_b", "n_a", "n_b", rule.percent)).select(*pairs.columns)


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b) with common, by their whole sets."""
    of = lambda c: sets.select(F.col("c").alias(c), F.col("s").alias(f"s_{c}"))
    both = pairs.select("a", "b", "n_a", "n_b").join(of("a"), "a").join(of("b"), "b")
    return both.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("common"))


def linked(percent: int, common: str = "common") -> F.Column:
    return (100 + percent) * F.col(common) >= percent * (F.col("n_a") + F.col("n_b")).cast("long")


def parents(links: DataFrame) -> DataFrame:
    """c, parent, n_p, own (shingles of c that the parent lacks), lost (those of the parent that c lacks): the linked set
    that each class shares most with."""
    way = lambda x, y: links.select(F.col(x).alias("c"), F.struct("common", F.col(y).alias("parent"), F.col(f"n_{x}").alias("n_c"), F.col(f"n_{y}").alias("n_p")).alias("p"))
    best = way("a", "b").unionByName(way("b", "a")).groupBy("c").agg(F.max("p").alias("p"))
    return best.select("c", "p.parent", "p.n_p", (F.col("p.n_c") - F.col("p.common")).alias("own"), (F.col("p.n_p") - F.col("p.common")).alias("lost"))


def derived(pairs: DataFrame, known: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b, n_a, n_b) with the parents p and q (n_p, n_q) of each end, what the ends differ from them by, and
    the pairs of parents as (a, b, n_a, n_b); a class without a parent is its own."""
    for c, p, n in (("a", "p", "n_p"), ("b", "q", "n_q")):
        of = known.select(F.col("c").alias(c), F.col("parent").alias(p), F.col("n_p").alias(n), F.col("own").alias(f"own_{c}"), F.col("lost").alias(f"lost_{c}"))
        zero = F.lit(0).cast("long")
        pairs = pairs.join(of, c, "left").withColumns({p: F.coalesce(p, c), n: F.coalesce(n, f"n_{c}"), f"own_{c}": F.coalesce(f"own_{c}", zero), f"lost_{c}": F.coalesce(f"lost_{c}", zero)})
    asked = pairs.select(*_oriented("p", "n_p", "q", "n_q")).drop("shared").distinct()
    return pairs, asked


def answered(pairs: DataFrame, between: DataFrame, percent: int) -> DataFrame:
    """Pairs of :func:`derived` with link: true or false where it follows from their parents' overlap ``between``, else null."""
    of = between.select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("common").alias("_o"))
    low, high = F.least("p", "q"), F.greatest("p", "q")
    out = pairs.join(of, (low == F.col("_a")) & (high == F.col("_b")))
    out = out.withColumns({"_most": F.col("_o") + F.col("own_a") + F.col("own_b"), "_least": F.col("_o") - F.col("lost_a") - F.col("lost_b")})
    return out.select("a", "b", "n_a", "n_b", F.when(linked(percent, "_least"), True).when(~linked(percent, "_most"), False).alias("link"))


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"of_{c}"))
    out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.where(F.coalesce("of_a", "a") != F.coalesce("of_b", "b")).drop("of_a", "of_b")


def _ids(*pairs: DataFrame) -> DataFrame:
    ends = [p.select(F.col(c).alias("c")) for p in pairs for c in ("a", "b")]
    return functools.reduce(DataFrame.unionByName, ends).distinct()


def class_labels(docs: DataFrame, base: DataFrame, rule: Rule = Rule(), text: str = "text", twins: np.ndarray | None = None) -> DataFrame:
    """node, label: the component of every class with a link; ``base``: the written :func:`members`."""
    bits = docs.sparkSession.sparkContext.broadcast(frequent(base, rule))
    both = frames.written(pairs_of_lists(listed(base, rule, bits, False), rule))
    listed_pairs = _summed(both.where("shared >= 0"))
    more_long = both.where("shared < 0").select(F.col("a").alias("t"), F.col("b").alias("cls"), F.col("n_a").alias("n"), F.col("n_b").alias("place"))
    long = frames.written(listed(base, rule, bits, True).unionByName(more_long).distinct())
    classes = _ids(both.where("shared >= 0")).unionByName(long.select(F.col("cls").alias("c"))).distinct()
    sketches = sketches_of(docs, text, classes, rule, twins)
    pairs = frames.written(close_pairs(listed_pairs, sketches, rule))
    frames.discard(both)
    # first: each class's pair of most shared shingles, and the pivots
    row = F.struct("shared", "a", "b", "n_a", "n_b")
    ends = pairs.select(F.col("a").alias("c"), row.alias("p")).unionByName(pairs.select(F.col("b").alias("c"), row.alias("p")))
    best = ends.groupBy("c").agg(F.max("p").alias("p")).select("p.a", "p.b", "p.n_a", "p.n_b")
    pivots = close_pairs(pivot_pairs(long, rule).select("a", "b", "n_a", "n_b"), sketches, rule)
    first = frames.written(best.unionByName(pivots).distinct())
    sets = sets_of(docs, text, _ids(pairs, first), rule, twins)
    links = frames.written(overlaps(first, sets).where(linked(rule.percent)))
    labels = components(links)
    # then: what is left across components, as far as it doesn't follow from the answers so far
    rest = pairs.select("a", "b", "n_a", "n_b").join(first, ["a", "b"], "left_anti").unionByName(cross_pairs(long, labels, sketches, rule).select("a", "b", "n_a", "n_b"))
    rest = frames.written(_across(rest.distinct(), labels))
    frames.discard(long, pairs, sketches)
    if rest.isEmpty():
        return labels
    rest, asked = derived(rest, frames.written(parents(links)), rule.percent)
    rest, asked = frames.written(rest), frames.written(asked)
    more = _ids(asked).join(sets, "c", "left_anti")
    if not more.isEmpty():
        sets = sets.unionByName(sets_of(docs, text, more, rule, twins))
    told = frames.written(answered(rest, frames.written(overlaps(asked, sets)), rule.percent))
    open_ = told.where("link is null").select("a", "b", "n_a", "n_b")
    more = _ids(open_).join(sets, "c", "left_anti")
    if not more.isEmpty():
        sets = sets.unionByName(sets_of(docs, text, more, rule, twins))
    found = frames.written(told.where("link").select("a", "b").unionByName(overlaps(open_, sets).where(linked(rule.percent)).select("a", "b")))
    if found.isEmpty():
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(found))


def labelled(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, same, n_shingles, comp (null without words) and first, the smallest key of the component, of every row."""
    twins = None
    while True:
        base = frames.written(members(docs, rule, key, text, twins))
        classes = frames.written(base.where("cls is not null").groupBy("cls").agg(F.min("key").alias("first"), F.min("other").alias("_low"), F.max("other").alias("_high")))
        found = classes.where("_low <> _high").select("cls").toPandas().cls.to_numpy(np.int64)  # classes squared / 2**65 rows
        if twins is not None or not len(found):
            break
        twins = found
    labels = class_labels(docs, base, rule, text, twins)
    named = classes.join(labels, F.col("cls") == F.col("node"), "left").select("cls", "first", F.coalesce("label", "cls").alias("comp"))
    named = frames.written(named)
    firsts = named.groupBy("comp").agg(F.min("first").alias("first"))
    named = named.drop("first").join(firsts, "comp").select("cls", "comp", "first")
    return base.join(named, "cls", "left").select("key", "same", "n_shingles", "comp", "first")


def join(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles and component_id, the smallest key that the text reaches over links, of every row."""
    return labelled(docs, rule, key, text).select(F.col("key").alias(key), "n_shingles", F.coalesce("first", "key").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", most: int = 500_000) -> DataFrame:
    """One row of each component, as it was: that of the smallest key (null last), and of its rows of one key that of the
    least text hash; of whole repeated rows one.  Rows without words stay.

    What goes meets the texts by key and text hash, by broadcast where it proves to be ``most`` rows at the most, else by a
    shuffle."""
    rows = frames.written(labelled(docs, rule, key).where("comp is not null").select("key", "same", "comp"))
    rank = F.struct(F.col("key").isNull().alias("none"), "key", "same")
    best = rows.groupBy("comp").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("key", "same"), F.lit(rule.salts)).cast("int"))
    marked = salted.join(_to_all(best.where("n > 1"), rule), ["comp", "salt"]).drop("salt")
    gone = marked.where(rank != F.col("best")).select(F.col("key").alias(key), F.col("same").alias("_same"))
    left = frames.without(docs, gone, key, most)
    repeated = frames.written(marked.where(rank == F.col("best")).groupBy("key", "same").agg(F.count("*").alias("n")).where("n > 1"))
    if repeated.isEmpty():
        return left
    # rows of one key and text: one of them, whichever; all others as they are
    mine = left.withColumn("_same", frames.same_text())
    on = lambda d: d[key].eqNullSafe(repeated["key"]) & (d["_same"] == repeated["same"])
    twice = mine.join(repeated, on(mine), "left_semi")
    one = twice.groupBy(key, "_same").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("_row")).select("_row.*")
    return mine.join(repeated, on(mine), "left_anti").select(*docs.columns).unionByName(one.select(*docs.columns))


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The same components for DuckDB, by all pairs of documents that share a shingle.
SQL = rf"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingled AS (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                             WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM worded),
sets AS (SELECT DISTINCT doc_id, s FROM shingled),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, w.b FROM reach r JOIN ways w ON w.a = r.other)
SELECT d.doc_id, coalesce(z.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes z USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY 1) r USING (doc_id)
"""
