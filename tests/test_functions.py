import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidelog.functions import hashing as H
from tidelog.functions import msgpack as M

values = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 64) - 1) | st.floats(allow_nan=False) | st.text(max_size=300) | st.binary(max_size=300), lambda x: st.lists(x, max_size=20) | st.dictionaries(st.text(max_size=5), x, max_size=20), max_leaves=20)


@settings(max_examples=200, deadline=None)
@given(values)
def test_round_trip(value):
    assert M.unpack(M.pack(value)) == value


def test_bytes_of_keys():
    assert M.pack("key") == b"\xa3key" and M.pack(1) == b"\x01" and M.pack(1.0) == b"\xcb\x3f\xf0" + bytes(6) and M.pack("1") == b"\xa11"
    assert M.pack(M.F32(42)) == b"\xca\x42\x28\0\0" and M.pack(True) == b"\xc3"
    for broken in (b"\xa3ke", b"\xc1", b"\x01\x01", b"\xcd\x01"):
        with pytest.raises((ValueError, IndexError)):
            M.unpack(broken)


def test_hashes():
    """Known hashes of shard names and of keys."""
    known = {b"a-0": 2727548292, b"b-0": 1121949192, b"c-0": 2242724227, b"\xa3key": 1211368233, b"\xa3KEY": 791967430}
    assert {k: H.murmur3_of(k) for k in known} == known


def test_columns(spark):
    edges = [0, 1, 31, 32, 127, 128, 255, 256, 65535, 65536, (1 << 32) - 1, 1 << 32, (1 << 63) - 1]
    ints = sorted({s * n + d for n in edges for s in (1, -1) for d in (-1, 0, 1) if -(1 << 63) <= s * n + d < 1 << 63})
    rng = random.Random(1)
    strings = ["", "a", "é" * 16, *("x" * n for n in (31, 32, 255, 256, 65535, 65536)), *("".join(rng.choices("abcß☃", k=k)) for k in range(40))]
    rows = spark.createDataFrame([(n, None, None) for n in ints] + [(None, s, None) for s in strings] + [(None, None, b) for b in (True, False, None)], "n long, s string, b boolean")
    key = F.coalesce(M.encode_int(F.col("n")), M.encode_string(F.col("s")), M.encode_bool(F.col("b")))
    out = rows.select("*", key.alias("key"), H.murmur3(key).alias("h")).collect()
    for r in out:
        value = next((x for x in (r.n, r.s, r.b) if x is not None), None)
        if value is None:
            assert r.key is None and r.h is None
        else:
            assert bytes(r.key) == M.pack(value) and r.h == H.murmur3_of(M.pack(value))
    shown = spark.createDataFrame([(bytearray(M.pack({"a": [1, None, "x"]})),), (bytearray(b""),), (None,)], "d binary").select(M.to_json(F.col("d")).alias("j")).collect()
    assert [r.j for r in shown] == ['{"a": [1, null, "x"]}', None, None]


def test_intervals(spark):
    top = (1 << 32) - 1
    rows = spark.createDataFrame([(h, s, e) for h in (0, 5, 10, 11, top) for s in (0, 5, 10, top) for e in (0, 5, 10, top)], "h long, s long, e long")
    for r in rows.select("*", H.in_interval(F.col("h"), F.col("s"), F.col("e")).alias("y")).collect():
        want = r.s < r.h <= r.e if r.s < r.e else r.h > r.s or r.h <= r.e
        assert r.y == want
