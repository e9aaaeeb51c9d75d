"""Keys and documents as MessagePack bytes.

Two keys are one key exactly when their bytes are equal: 1, 1.0 and "1" are three keys.  Columns are encoded by built-in
functions; :func:`pack` and :func:`unpack` do single values on the driver and, in Arrow batches, whole documents.
"""

from __future__ import annotations

import json
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class F32(float):
    """A number to be stored in single precision."""


def pack(value) -> bytes:
    """The shortest encoding of a value."""
    if value is None:
        return b"\xc0"
    if isinstance(value, bool):
        return b"\xc3" if value else b"\xc2"
    if isinstance(value, int):
        return _pack_int(value)
    if isinstance(value, F32):
        return b"\xca" + struct.pack(">f", value)
    if isinstance(value, float):
        return b"\xcb" + struct.pack(">d", value)
    if isinstance(value, str):
        raw = value.encode()
        return _head(len(raw), 0xA0, 32, (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(value, (bytes, bytearray)):
        return _head(len(value), 0, 0, (0xC4, 0xC5, 0xC6)) + bytes(value)
    if isinstance(value, (list, tuple)):
        return _head(len(value), 0x90, 16, (None, 0xDC, 0xDD)) + b"".join(map(pack, value))
    if isinstance(value, dict):
        return _head(len(value), 0x80, 16, (None, 0xDE, 0xDF)) + b"".join(pack(x) for kv in value.items() for x in kv)
    raise TypeError(f"no encoding of {type(value).__name__}")


def _pack_int(n: int) -> bytes:
    if -32 <= n < 128:
        return (n & 0xFF).to_bytes(1, "big")
    kinds = ((0xCC, 1), (0xCD, 2), (0xCE, 4), (0xCF, 8)) if n >= 0 else ((0xD0, 1), (0xD1, 2), (0xD2, 4), (0xD3, 8))
    for code, size in kinds:
        if (n < 1 << 8 * size) if n >= 0 else n >= -(1 << 8 * size - 1):
            return bytes([code]) + n.to_bytes(size, "big", signed=n < 0)
    raise OverflowError(n)


def _head(n: int, fixed: int, below: int, codes: tuple) -> bytes:
    if n < below:
        return bytes([fixed | n])
    for code, size in zip(codes, (1, 2, 4)):
        if code is not None and n < 1 << 8 * size:
            return bytes([code]) + n.to_bytes(size, "big")
    raise OverflowError(n)


def unpack(data: bytes):
    """The value that ``data`` holds, all of it."""
    value, at = _unpack(data, 0)
    if at != len(data):
        raise ValueError(f"{len(data) - at} bytes after the value")
    return value


def _unpack(data: bytes, at: int):
    code, at = data[at], at + 1

    def take(n: int) -> tuple[bytes, int]:
        if at + n > len(data):
            raise ValueError("the value is cut off")
        return data[at : at + n], at + n

    def size(n: int) -> tuple[int, int]:
        raw, to = take(n)
        return int.from_bytes(raw, "big"), to

    def several(n: int, at: int) -> tuple[list, int]:
        out = []
        for _ in range(n):
            value, at = _unpack(data, at)
            out.append(value)
        return out, at

    if code < 0x80:
        return code, at
    if code >= 0xE0:
        return code - 256, at
    if code in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[code], at
    if code in (0xCA, 0xCB):
        raw, at = take(4 if code == 0xCA else 8)
        return struct.unpack(">f" if code == 0xCA else ">d", raw)[0], at
    if 0xCC <= code <= 0xD3:
        raw, at = take(1 << (code - 0xCC & 3))
        return int.from_bytes(raw, "big", signed=code >= 0xD0), at
    n = None
    if 0xA0 <= code < 0xC0:
        kind, n = "s", code & 31
    elif 0x90 <= code < 0xA0:
        kind, n = "l", code & 15
    elif code < 0x90:
        kind, n = "m", code & 15
    else:
        kinds = {0xD9: ("s", 1), 0xDA: ("s", 2), 0xDB: ("s", 4), 0xC4: ("b", 1), 0xC5: ("b", 2), 0xC6: ("b", 4), 0xDC: ("l", 2), 0xDD: ("l", 4), 0xDE: ("m", 2), 0xDF: ("m", 4)}
        if code not in kinds:
            raise ValueError(f"no value begins with {code:#x}")
        kind, width = kinds[code]
        n, at = size(width)
    if kind in "sb":
        raw, at = take(n)
        return raw.decode() if kind == "s" else raw, at
    values, at = several(n if kind == "l" else 2 * n, at)
    return values if kind == "l" else dict(zip(values[::2], values[1::2])), at


def _fixed(n: Column, digits: int) -> Column:
    """The last hexadecimal digits of a number, in two's complement."""
    return F.right(F.concat(F.lit("0" * 16), F.hex(n)), F.lit(digits))


def encode_int(n: Column) -> Column:
    """MessagePack bytes of a whole number; null stays null."""
    n = n.cast("long")
    code = (
        F.when((n >= 0) & (n < 128), _fixed(n, 2))
        .when((n < 0) & (n >= -32), _fixed(n, 2))
        .when((n >= 0) & (n < 1 << 8), F.concat(F.lit("CC"), _fixed(n, 2)))
        .when((n >= 0) & (n < 1 << 16), F.concat(F.lit("CD"), _fixed(n, 4)))
        .when((n >= 0) & (n < 1 << 32), F.concat(F.lit("CE"), _fixed(n, 8)))
        .when(n >= 0, F.concat(F.lit("CF"), _fixed(n, 16)))
        .when(n >= -(1 << 7), F.concat(F.lit("D0"), _fixed(n, 2)))
        .when(n >= -(1 << 15), F.concat(F.lit("D1"), _fixed(n, 4)))
        .when(n >= -(1 << 31), F.concat(F.lit("D2"), _fixed(n, 8)))
        .when(n < 0, F.concat(F.lit("D3"), _fixed(n, 16)))
    )
    return F.unhex(code)


def encode_string(s: Column) -> Column:
    """MessagePack bytes of a string; null stays null."""
    raw = F.encode(s, "UTF-8")
    n = F.octet_length(raw).cast("long")
    head = (
        F.when(n < 32, _fixed(n + 0xA0, 2))
        .when(n < 1 << 8, F.concat(F.lit("D9"), _fixed(n, 2)))
        .when(n < 1 << 16, F.concat(F.lit("DA"), _fixed(n, 4)))
        .when(n.isNotNull(), F.concat(F.lit("DB"), _fixed(n, 8)))
    )
    return F.concat(F.unhex(head), raw)


def encode_bool(b: Column) -> Column:
    return F.unhex(F.when(b, F.lit("C3")).when(~b, F.lit("C2")))


def to_json(data: Column) -> Column:
    """Documents as JSON text, in Arrow batches; bytes inside become hexadecimal text.  For inspection, not the hot path."""
    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        shown = lambda x: x.hex()
        return column.map(lambda b: None if b is None or len(b) == 0 else json.dumps(unpack(bytes(b)), default=shown))

    return decode(data)
