"""Media columns in Matroska: write samples as a file, and parse any file into packet tables.

The parser reads variable-length EBML ids and sizes (unknown sizes too), clusters, SimpleBlocks and BlockGroups, the
three kinds of lacing, and cues.  A packet is a frame: its track, timestamp, flags and the byte range that holds it.  The
frames of a lace follow each other by the group's BlockDuration, shared out evenly, or else the track's DefaultDuration;
without either they share the block's timestamp.

Null text counts as empty and is stored as 64 zero bytes; equal payloads give equal files; rows of equal ids stay apart; an
empty table gives an empty result.  Bytes that aren't a Matroska file raise :class:`Broken`; with ``strict=False`` such a
row has null fields, or no packets and cues.  A null file always has null fields, or none.  New columns replace kept ones
of the same name; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import frames

# Fixed values of the Matroska format: element ids, with their marker bits.
EBML, SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE
NUMBER, UID, KIND, CODEC, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x4282, 0x4287, 0x4285
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
_MASTERS = {SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS, EBML}
#: What an element of unknown size can't hold: it ends where one of these begins.
_ENDS = {CLUSTER: {CLUSTER, CUES, TRACKS, INFO, SEGMENT, EBML}, SEGMENT: {SEGMENT, EBML}}

UNIT = 64  # payloads are padded to a multiple
FRAME, LACE, BLOCKS = 512, 8, 16  # bytes a frame, frames a block, blocks a cluster
SAMPLE_RATE = 8000


class Broken(ValueError):
    """Bytes that aren't a whole Matroska file."""


def vint(n: int, width: int = 0) -> bytes:
    """A size as a variable-length integer."""
    k = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * k).to_bytes(k, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(track: int, offset: int, parts: list[bytes], lacing: int | None = None) -> bytes:
    """A SimpleBlock of one frame or a lace; without ``lacing``, fixed sizes if they are equal and else EBML sizes."""
    if lacing is None:
        lacing = NO_LACING if len(parts) == 1 else FIXED if len({len(p) for p in parts}) == 1 else EBML_LACING
    head = vint(track) + struct.pack(">hB", offset, 0x80 | lacing << 1)
    if lacing:
        head += bytes([len(parts) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (len(p) // 255) + bytes([len(p) % 255]) for p in parts[:-1])
    elif lacing == EBML_LACING:
        sizes = [len(p) for p in parts]
        head += vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            k = next(k for k in range(1, 9) if abs(b - a) < 1 << 7 * k - 1)
            head += vint(b - a + (1 << 7 * k - 1) - 1, k)
    return element(SIMPLE, head + b"".join(parts))


_HEAD = element(EBML, element(DOCTYPE, b"matroska") + number(DOCTYPE_VERSION, 4) + number(DOCTYPE_READ, 2))
_TRACKS = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // SAMPLE_RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(RATE, struct.pack(">d", SAMPLE_RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """A file with one track of 8-bit samples."""
    step = FRAME * 1000 // SAMPLE_RATE
    body = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / SAMPLE_RATE))) + _TRACKS
    parts, cues = [body], []
    at = len(body)
    span = FRAME * LACE * BLOCKS
    for start in range(0, len(payload), span):
        first = start // FRAME * step
        inside = [number(TIME, first)]
        for k in range(start, min(start + span, len(payload)), FRAME * LACE):
            lace = [payload[i : i + FRAME] for i in range(k, min(k + FRAME * LACE, len(payload)), FRAME)]
            inside.append(block(1, k // FRAME * step - first, lace))
        cues.append(element(POINT, number(CUE_TIME, first) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, b"".join(inside)))
        at += len(parts[-1])
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def _vint(data: bytes, at: int, end: int, marker: bool = False) -> tuple[int, int, int]:
    """Value, width and the place after it; an unknown size is -1."""
    if at >= end or not data[at]:
        raise Broken(f"no variable-length integer at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Broken(f"an integer is cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if not marker:
        n ^= 1 << 7 * width
        n = -1 if n == (1 << 7 * width) - 1 else n
    return n, width, at + width


def elements(data: bytes, at: int, end: int, ends: frozenset | set = frozenset()) -> Iterator[tuple[int, int, int]]:
    """Id, first byte and end of each element of a body; a body of unknown size stops before an id in ``ends``."""
    while at < end:
        ident, _, body = _vint(data, at, end, True)
        if ident in ends:
            return
        n, _, body = _vint(data, body, end)
        if n < 0:
            if ident not in _ENDS:
                raise Broken(f"element {ident:x} at {at} may not have an unknown size")
            stop = body
            for _, _, stop in elements(data, body, end, _ENDS[ident]):  # noqa: B007
                pass
        else:
            stop = body + n
        if stop > end:
            raise Broken(f"element {ident:x} at {at} is cut off")
        yield ident, body, stop
        at = stop


@dataclass
class File:
    #: (track, the block's timestamp in ticks of ``scale`` ns, first byte, size, keyframe, kind of lacing, ns since the block's
    #: timestamp)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)  # time, track, first byte of the cluster
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    duration: float = 0.0


def _uint(data: bytes, a: int, b: int) -> int:
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise Broken(f"a float of {b - a} bytes at {a}")
    return struct.unpack(">d" if b - a == 8 else ">f", data[a:b])[0] if b > a else 0.0


def _track(data: bytes, a: int, b: int) -> tuple[int, dict]:
    """Number and description of a track entry."""
    values = {k: (x, y) for k, x, y in elements(data, a, b)}
    for k, name in ((NUMBER, "number"), (KIND, "type"), (CODEC, "codec")):
        if k not in values:
            raise Broken(f"the track at {a} has no {name}")
    inner = {k: (x, y) for k, x, y in elements(data, *values[AUDIO])} if AUDIO in values else {}
    return _uint(data, *values[NUMBER]), {
        "kind": _uint(data, *values[KIND]),
        "codec": data[slice(*values[CODEC])].decode("utf-8", "replace"),
        "frame_ns": _uint(data, *values[DEFAULT_DURATION]) if DEFAULT_DURATION in values else None,
        "rate": _float(data, *inner[RATE]) if RATE in inner else None,
        "depth": _uint(data, *inner[DEPTH]) if DEPTH in inner else None,
    }


def lace_sizes(data: bytes, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of the frames of a block whose lace begins at ``at``, and where the first frame begins."""
    if lacing == NO_LACING:
        return [end - at], at
    if at >= end:
        raise Broken("a lace is cut off")
    n, at = data[at] + 1, at + 1
    if lacing == FIXED:
        if (end - at) % n:
            raise Broken("a lace of fixed sizes has unequal frames")
        return [(end - at) // n] * n, at
    sizes = []
    for k in range(n - 1):
        if lacing == XIPH:
            size = 0
            while True:
                if at >= end:
                    raise Broken("a lace is cut off")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
        else:
            size, width, at = _vint(data, at, end)
            if k:
                size = sizes[-1] + (size if size >= 0 else (1 << 7 * width) - 1) - ((1 << 7 * width - 1) - 1)
        sizes.append(size)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Broken("a lace is longer than its block")
    return [*sizes, last], at


def _block(out: File, data: bytes, a: int, b: int, cluster: int, key: bool | None, lasts: int | None = None) -> None:
    """Adds a block's frames; ``lasts``: ticks of the whole block.  The last field is for now (frame, frames, lasts)."""
    track, _, at = _vint(data, a, b)
    if at + 3 > b:
        raise Broken("a block is cut off")
    offset, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    sizes, at = lace_sizes(data, at + 3, b, lacing)
    for k, size in enumerate(sizes):
        out.packets.append((track, cluster + offset, at, size, bool(flags & 0x80) if key is None else key, lacing, (k, len(sizes), lasts)))
        at += size


def parse(data: bytes) -> File:
    """The packet table and indexes of a file."""
    out = File()
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML or not any(i == SEGMENT for i, _, _ in top):
        raise Broken("no EBML head and segment")
    for ident, base, stop in top:
        if ident != SEGMENT:
            continue
        for kind, a, b in elements(data, base, stop):
            if kind == INFO:
                for i, c, d in elements(data, a, b):
                    if i == SCALE:
                        out.scale = _uint(data, c, d)
                    elif i == DURATION:
                        out.duration = _float(data, c, d)
            elif kind == TRACKS:
                for i, c, d in elements(data, a, b):
                    if i == ENTRY:
                        name, described = _track(data, c, d)
                        out.tracks[name] = described
            elif kind == CLUSTER:
                width = 4  # the id's bytes come before the size
                start = a
                while data[start - width : start] != CLUSTER.to_bytes(4, "big"):
                    start -= 1
                out.clusters.append(start - width)
                time = 0
                for i, c, d in elements(data, a, b, _ENDS[CLUSTER]):
                    if i == TIME:
                        time = _uint(data, c, d)
                    elif i == SIMPLE:
                        _block(out, data, c, d, time, None)
                    elif i == GROUP:
                        inside = list(elements(data, c, d))
                        key = not any(k == REFERENCE for k, _, _ in inside)
                        lasts = next((_uint(data, x, y) for k, x, y in inside if k == BLOCK_DURATION), None)
                        for k, x, y in inside:
                            if k == BLOCK:
                                _block(out, data, x, y, time, key, lasts)
            elif kind == CUES:
                for i, c, d in elements(data, a, b):
                    if i != POINT:
                        continue
                    time = 0
                    for k, x, y in elements(data, c, d):
                        if k == CUE_TIME:
                            time = _uint(data, x, y)
                        elif k == POSITIONS:
                            at = {q: _uint(data, v, w) for q, v, w in elements(data, x, y)}
                            out.cues.append((time, at.get(CUE_TRACK, 0), base + at.get(CUE_CLUSTER, 0)))

    def since(track: int, frame: int, frames_: int, lasts: int | None) -> int:
        if lasts is not None:
            return frame * lasts * out.scale // frames_
        return frame * ((out.tracks.get(track) or {}).get("frame_ns") or 0)

    out.packets = [(*p[:6], since(p[0], *p[6])) for p in out.packets]  # tracks may come after clusters
    return out


def payload_of(data: bytes, out: File, track: int = 1) -> bytes:
    return b"".join([data[p[2] : p[2] + p[3]] for p in out.packets if p[0] == track])


def store(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep``, n_bytes (of the UTF-8 text) and media, the file that holds the padded payload."""

    def make():
        def f(data, offsets, rows):
            size = np.diff(offsets)
            padded = np.maximum(UNIT, -(-size // UNIT) * UNIT)
            media = [write(data[a:b].tobytes().ljust(n, b"\0")) for a, b, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), padded.tolist())]
            return [size, pa.array(media, pa.large_binary())]

        return f

    return frames.map_text(docs, make, "n_bytes bigint, media binary", keep, text)


def read_back(media: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes"), column: str = "media", strict: bool = True) -> DataFrame:
    """``keep`` and digests and features of what the files hold, from their packets."""
    fields = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    new = T._parse_datatype_string(fields)
    keep = tuple(c for c in keep if c not in new.names)
    schema = T.StructType([media.schema[c] for c in keep] + list(new.fields))

    def one(x: pa.Scalar) -> tuple:
        if not x.is_valid:
            return (None,) * 6
        data = x.as_buffer().to_pybytes()
        try:
            f = parse(data)
        except Broken:
            if strict:
                raise
            return (None,) * 6
        payload = payload_of(data, f)
        samples = np.frombuffer(payload, np.uint8)
        total, cued = int(samples.sum()), len({c[2] for c in f.cues} & set(f.clusters))
        feature = f"packets={len(f.packets)};clusters={len(f.clusters)};cued={cued};duration_ms={f.duration:.3f};mean={total / max(1, len(payload)):.4f};peak={int(samples.max(initial=0))}"
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            made = list(zip(*[one(x) for x in batch.column(len(keep))])) or [[]] * 6
            arrays = [batch.column(i) for i in range(len(keep))] + [pa.array(list(x)) for x in made]
            yield pa.RecordBatch.from_arrays([x.cast(t.type) for x, t in zip(arrays, out)], schema=out)

    return frames.in_batches(media).select(*keep, column).mapInArrow(run, schema)


def _rows_of_files(media: DataFrame, keep: tuple[str, ...], column: str, strict: bool, fields: str, rows) -> DataFrame:
    """``keep`` and the columns ``rows(file)`` (a list of tuples) of every row."""
    new = T._parse_datatype_string(fields)
    keep = tuple(c for c in keep if c not in new.names)
    schema = T.StructType([media.schema[c] for c in keep] + list(new.fields))

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for k, x in enumerate(batch.column(len(keep))):
                if not x.is_valid:
                    continue
                try:
                    made = rows(parse(x.as_buffer().to_pybytes()))
                except Broken:
                    if strict:
                        raise
                    continue
                if made:
                    arrays = [batch.column(i).take(pa.array([k] * len(made))) for i in range(len(keep))] + [pa.array(list(y)) for y in zip(*made)]
                    yield pa.RecordBatch.from_arrays([y.cast(t.type) for y, t in zip(arrays, out)], schema=out)

    return frames.in_batches(media).select(*keep, column).mapInArrow(run, schema)


def packet_table(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media", strict: bool = True) -> DataFrame:
    """A row for each packet: ``keep``, packet (its number), track, timestamp_ns, first_byte, n_bytes, keyframe, lacing."""
    fields = "packet bigint, track bigint, timestamp_ns bigint, first_byte bigint, n_bytes bigint, keyframe boolean, lacing int"
    rows = lambda f: [(k, p[0], p[1] * f.scale + p[6], *p[2:6]) for k, p in enumerate(f.packets)]
    return _rows_of_files(media, keep, column, strict, fields, rows)


def cue_table(media: DataFrame, keep: tuple[str, ...] = ("doc_id",), column: str = "media", strict: bool = True) -> DataFrame:
    """A row for each cue: ``keep``, cue (its number), track, timestamp_ns, cluster_byte, and packet, the first of the track
    in that cluster (null if the cue leads to none)."""

    def rows(f: File) -> list[tuple]:
        first: dict[tuple[int, int], int] = {}
        starts = sorted(f.clusters)
        for k, p in enumerate(f.packets):
            first.setdefault((starts[bisect.bisect_right(starts, p[2]) - 1], p[0]), k)
        return [(k, track, time * f.scale, at, first.get((at, track))) for k, (time, track, at) in enumerate(f.cues)]

    return _rows_of_files(media, keep, column, strict, "cue bigint, track bigint, timestamp_ns bigint, cluster_byte bigint, packet bigint", rows)
