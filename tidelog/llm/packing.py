"""Packed token-id matrices: rows of fixed width that hold whole documents where they can.

Texts are encoded with begin and end ids.  A text longer than the width gives full pieces and a rest; all pieces of the
table are packed by best-fit decreasing: the longest first, each into the open row with the least room that still holds
it, found by a segment tree over the amounts of room.  Full pieces are rows of their own and never move.

What best fit does depends only on how many pieces have each length, so the driver runs it on that count (a number for each
length up to the width, however large the table is): pieces of one length go into all rows of one room at once, and rows
that were filled alike stay one group.  The plan has a few groups for each length; a piece finds its row by its rank among
the pieces of its length.  Ranks go by a hash of the id, in slices, so no length lands in one task, and the packing doesn't
depend on how the input is split.  Rows keep which document and which part of it each segment is, so :func:`unpack` gives
every text's ids back.

A null or empty text is the begin and end ids; rows of equal ids stay apart (segments are told apart by ``part``); an empty
table gives no rows; columns other than the id and the text are ignored, whatever their names.  Ids are 16-bit numbers: a
vocabulary of more than 65,536 pieces is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .frames import in_batches, join_small, written
from .pieces import CHUNK, check, encoder, model_path


@dataclass(frozen=True)
class Rule:
    """width: ids a row; slice: pieces of one length, about, that one task ranks."""

    width: int = 2048
    padding: int = 0
    slice: int = 500


@dataclass
class Group:
    """Rows that are filled alike: how many, and the (length, pieces) that each holds, longest first."""

    rows: int
    holds: tuple[tuple[int, int], ...] = ()


class Rooms:
    """The groups of open rows by their room, as a segment tree: a node is how many amounts of room below it are taken."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.below = [0] * (2 * self.size)
        self.groups: list[list[Group]] = [[] for _ in range(width + 1)]

    def _count(self, room: int, change: int) -> None:
        at = room + self.size
        while at:
            self.below[at] += change
            at >>= 1

    def put(self, group: Group, room: int) -> None:
        if group.rows:
            self.groups[room].append(group)
            if len(self.groups[room]) == 1:
                self._count(room, 1)

    def take(self, need: int) -> tuple[Group, int] | None:
        """A group with the least room of at least ``need``, and its room; it is open no more."""
        at = need + self.size
        if not self.below[at]:
            # up to the first subtree on the right that has one, and down to its first
            while at > 1 and (at & 1 or not self.below[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.size:
                at = 2 * at if self.below[2 * at] else 2 * at + 1
        room = at - self.size
        group = self.groups[room].pop()
        if not self.groups[room]:
            self._count(room, -1)
        return group, room


def best_fit(counts: dict[int, int], width: int) -> list[Group]:
    """The rows that best-fit decreasing makes of ``counts`` pieces of each length (1 to ``width``)."""
    rooms = Rooms(width)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            # a piece goes where the one before it went as long as there is room: no other row has less
            group, room = rooms.take(length) or (Group(-(-left // (width // length))), width)
            each = room // length
            whole = min(group.rows, left // each)
            rooms.put(Group(whole, (*group.holds, (length, each))), room - each * length)
            left -= whole * each
            if whole < group.rows:
                if left:
                    rooms.put(Group(1, (*group.holds, (length, left))), room - left * length)
                rooms.put(Group(group.rows - whole - (left > 0), group.holds), room)
                left = 0
    return [g for of in rooms.groups for g in of if g.holds]


@dataclass(frozen=True)
class Plan:
    """Where the pieces go: key = length * 2**40 + first rank of a run of pieces (ascending), the row of the run's first
    piece, pieces a row, and the slot of the first of a row."""

    key: np.ndarray
    row: np.ndarray
    each: np.ndarray
    slot: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and slot of pieces."""
        wanted = length << 40 | rank
        at = np.searchsorted(self.key, wanted, "right") - 1
        over = wanted - self.key[at]
        return self.row[at] + over // self.each[at], self.slot[at] + over % self.each[at]


def plan(groups: list[Group]) -> Plan:
    runs, used, row = [], {}, 0
    for g in groups:
        slot = 0
        for length, each in g.holds:
            first = used.get(length, 0)
            runs.append((length << 40 | first, row, each, slot))
            used[length] = first + g.rows * each
            slot += each
        row += g.rows
    columns = np.array(sorted(runs), np.int64).reshape(-1, 4)
    return Plan(*columns.T.copy())


def pieces_of(lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first id and length of every piece."""
    count = -(-lengths // width)
    text = np.repeat(np.arange(len(lengths)), count)
    start = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * width
    return text, start, np.minimum(width, lengths[text] - start)


def pieces(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", model_file: str | None = None) -> DataFrame:
    """name (the id), part, start, length and ids (16-bit numbers) of every piece of every text."""
    path = model_file or model_path()
    kind = dict(docs.dtypes)[key]
    schema = T._parse_datatype_string(f"name {kind}, part int, start bigint, length int, ids binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        own, out = encoder(path), to_arrow_schema(schema)
        if own.size > 1 << 16:
            raise ValueError(f"{path} has more than 65,536 pieces")
        for batch in batches:
            for a, b, data, offsets in K.chunks(batch.column(1), CHUNK):
                flat, ends = own.encode(data, offsets)
                check(own, flat, ends, data, offsets, int(offsets[-1]) % (b - a))
                flat = np.insert(flat, np.repeat(ends, [1, *[2] * (b - a - 1), 1]), np.tile([own.begin, own.end], b - a)).astype("<u2")
                size = np.diff(ends) + 2
                base = np.cumsum(size) - size
                at, start, length = pieces_of(size, rule.width)
                raw = pa.py_buffer(flat.tobytes())
                bounds = np.append(base[at] + start, len(flat)).astype(np.int32) * 2  # pieces lie one after the other
                ids = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.astype(np.int32).tobytes()), raw])
                made = [batch.column(0).slice(a, b - a).take(pa.array(at)), pa.array(start // rule.width), pa.array(start), pa.array(length), ids]
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, out)], schema=out)
        K.release()

    return in_batches(docs).select(key, F.col(text).alias("_text")).mapInArrow(run, schema)


def ranked(cut: DataFrame, most: int, rule: Rule = Rule()) -> DataFrame:
    """``cut`` (written) with rank, from 0, among the pieces of a length; ``most``: pieces of the most frequent length."""
    bits = min(16, max(0, (most - 1) // rule.slice).bit_length())
    hashed = cut.withColumn("_h", F.xxhash64(F.lit("pack"), "name", "part"))
    hashed = hashed.withColumn("_slice", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    counts = hashed.groupBy("length", "_slice").agg(F.count("*").alias("_n"))
    before = counts.select("length", "_slice", (F.sum("_n").over(Window.partitionBy("length").orderBy("_slice")) - F.col("_n")).alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_slice").orderBy("_h", "name", "part", "ids")) - 1
    placed = join_small(hashed.withColumn("_number", number), before, ["length", "_slice"], "inner")
    return placed.select("name", "part", "start", "length", "ids", (F.col("_before") + F.col("_number")).alias("rank"))


SCHEMA = "n_tokens int, ids binary, cu_seqlens array<int>, position_ids binary, {key} array<{kind}>, parts array<int>, starts array<bigint>"


def pack(docs: DataFrame, rule: Rule = Rule(), key: str = "doc_id", text: str = "text", model_file: str | None = None) -> DataFrame:
    """A row for each packed row: n_tokens, ids and position_ids (width little-endian 16-bit numbers; padding has position
    0), cu_seqlens, and the document id, part and first id of each segment in ``{key}s``, parts and starts."""
    cut = written(pieces(docs, rule, key, text, model_file))
    rest = cut.where(F.col("length") < rule.width)
    counts = {r.length: r.n for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    where = docs.sparkSession.sparkContext.broadcast(plan(best_fit(counts, rule.width)))
    kind = dict(docs.dtypes)[key]
    placed_schema = T._parse_datatype_string(f"row bigint, slot int, name {kind}, part int, start bigint, length int, ids binary")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, slot = where.value.find(*(np.asarray(batch.column(batch.schema.get_field_index(c))).astype(np.int64) for c in ("length", "rank")))
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(slot.astype(np.int32)), *batch.columns[:5]], names=placed_schema.names)

    placed = in_batches(ranked(rest, max(counts.values(), default=0), rule)).mapInArrow(place, placed_schema)
    schema = T._parse_datatype_string(SCHEMA.format(key=f"{key}s", kind=kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, held = to_arrow_schema(schema), None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            row = np.asarray(held.column(0))
            cut = int(np.searchsorted(row, row[-1])) if len(row) else 0  # the last row may go on in the next batch
            yield from rows(out, held.slice(0, cut))
            held = held.slice(cut)
        if held is not None:
            yield from rows(out, held)
        K.release()

    def rows(out: pa.Schema, table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        row, _, name, part, start, length, ids = (c.combine_chunks() for c in table.columns)
        row, length = np.asarray(row), np.asarray(length).astype(np.int64)
        flat = np.frombuffer(b"".join(ids.to_pylist()), "<u2")
        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        bounds = np.append(first, len(row))
        ends = np.append(0, np.cumsum(length))
        place = ends[:-1] - np.repeat(ends[first], np.diff(bounds))  # of a piece in its row
        inside = np.arange(len(flat)) - np.repeat(ends[:-1], length)
        slot = np.repeat(np.repeat(np.arange(len(first)), np.diff(bounds)) * rule.width + place, length) + inside
        matrix, places = np.full(len(first) * rule.width, rule.padding, "<u2"), np.zeros(len(first) * rule.width, "<u2")
        matrix[slot], places[slot] = flat, inside
        lists = lambda x: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), x)
        cumulative = [[0, *np.cumsum(length[a:b]).tolist()] for a, b in zip(bounds, bounds[1:])]
        step = 2 * rule.width
        binary = lambda m: pa.array([m[k : k + step] for k in range(0, len(m), step)], pa.binary())
        made = [pa.array(np.add.reduceat(length, first)), binary(matrix.tobytes()), pa.array(cumulative, pa.list_(pa.int32())), binary(places.tobytes()), lists(name), lists(part), lists(start)]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(made, out)], schema=out)

    # a piece of the whole width is a row by itself, where it lies; numbered so that no two neighbours have one number
    alone = cut.where(F.col("length") == rule.width).select(F.monotonically_increasing_id().alias("row"), F.lit(0).alias("slot"), *cut.columns)
    packed = placed.repartition("row").sortWithinPartitions("row", "slot").mapInArrow(run, schema)
    return in_batches(alone).mapInArrow(run, schema).unionByName(packed)


def write(packed: DataFrame, path: str) -> None:
    """The matrices as Parquet, a row of ids each, in files that any reader of fixed-width binaries can use."""
    packed.write.parquet(path)


def unpack(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, part, start and ids (as an array) of every segment: parts of a document in order are its ids."""
    kind = packed.schema[f"{key}s"].dataType.elementType.simpleString()
    schema = f"{key} {kind}, part int, start bigint, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for ids, cu, names, parts, starts in zip(*(c.to_pylist() for c in batch.columns)):
                flat = np.frombuffer(ids, "<u2").astype(np.int32)
                out += [(d, p, s, flat[a:b]) for d, p, s, a, b in zip(names, parts, starts, cu, cu[1:])]
            columns = list(zip(*out)) or [[], [], [], []]
            types = (batch.column(2).type.value_type, pa.int32(), pa.int64(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=[key, "part", "start", "ids"])

    return packed.select("ids", "cu_seqlens", f"{key}s", "parts", "starts").mapInArrow(run, schema)
