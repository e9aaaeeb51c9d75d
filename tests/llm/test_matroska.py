import hashlib
import random
import zlib

import pytest

from tidelog.llm import matroska as M


@pytest.mark.parametrize("n", [64, 128, 512, 576, 4096, 4160, 65536, 65600, 200_000 // 64 * 64])
def test_round_trip(n):
    payload = random.Random(n).randbytes(n)
    data = M.write(payload)
    f = M.parse(data)
    assert M.payload_of(data, f) == payload
    assert {c[2] for c in f.cues} == set(f.clusters)
    assert f.tracks[1]["depth"] == 8 and f.duration == n / 8
    assert [p[1] for p in f.packets] == sorted(p[1] for p in f.packets)


@pytest.mark.parametrize("lacing", [M.XIPH, M.EBML_LACING])
def test_lacing(lacing):
    parts = [b"a" * 300, b"", b"b" * 255, b"c" * 5, b"d" * 4000, b"e"]
    body = M.number(M.TIME, 7) + M.block(3, -2, parts, lacing)
    data = M._HEAD + M.element(M.SEGMENT, M.element(M.CLUSTER, body))
    f = M.parse(data)
    assert [data[p[2] : p[2] + p[3]] for p in f.packets] == parts
    assert {p[:2] for p in f.packets} == {(3, 5)} and {p[5] for p in f.packets} == {lacing}


def test_unknown_sizes_and_groups():
    group = M.element(M.GROUP, M.element(M.BLOCK, M.vint(1) + b"\0\5\0xyz") + M.element(M.REFERENCE, b"\1"))
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M.number(M.TIME, 10) + group
    data = M._HEAD + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + cluster + cluster
    f = M.parse(data)
    assert [(p[1], p[4], data[p[2] : p[2] + p[3]]) for p in f.packets] == [(15, False, b"xyz")] * 2


def test_broken():
    data = M.write(bytes(640))
    for cut in (b"", b"abc", data[:-1], data[: len(M._HEAD)]):
        with pytest.raises(M.Broken):
            M.parse(cut)


def test_query(spark):
    texts = ["", None, "abc", "é" * 40, "x" * 64, "y" * 70_000, "abc"]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in M.read_back(M.store(docs)).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_sha256 == hashlib.sha256(M.write(payload)).hexdigest()
    assert rows[2].feature == rows[6].feature
    assert M.read_back(M.store(docs.limit(0))).count() == 0
    packets = M.packet_table(M.store(docs)).collect()
    assert sum(p.n_bytes for p in packets) == sum(r.payload_bytes for r in rows.values())
    bad = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert M.packet_table(bad, strict=False).count() == 0


def test_timestamps_of_laces(spark):
    """By BlockDuration, else DefaultDuration, else the block's own; tracks may follow the clusters."""
    entry = lambda n, *more: M.element(M.ENTRY, b"".join([M.number(M.NUMBER, n), M.number(M.KIND, 2), M.element(M.CODEC, b"X"), *more]))
    lace = lambda track: M.vint(track) + b"\0\5" + bytes([M.FIXED << 1, 2]) + b"abcabc"
    group = M.element(M.GROUP, M.element(M.BLOCK, lace(1)) + M.number(M.BLOCK_DURATION, 30))
    cluster = M.element(M.CLUSTER, M.number(M.TIME, 10) + group + M.element(M.SIMPLE, lace(1)) + M.element(M.SIMPLE, lace(2)))
    cue = M.element(M.CUES, M.element(M.POINT, M.number(M.CUE_TIME, 10) + M.element(M.POSITIONS, M.number(M.CUE_TRACK, 2) + M.number(M.CUE_CLUSTER, 0))))
    data = M._HEAD + M.element(M.SEGMENT, cluster + M.element(M.TRACKS, entry(1, M.number(M.DEFAULT_DURATION, 7_000_000)) + entry(2)) + cue)
    media = spark.createDataFrame([(1, bytearray(data)), (1, bytearray(data))], "doc_id long, media binary")
    rows = M.packet_table(media.limit(1)).orderBy("packet").collect()
    assert [(r.track, r.timestamp_ns / 1e6) for r in rows] == [(1, 15), (1, 25), (1, 35), (1, 15), (1, 22), (1, 29), (2, 15), (2, 15), (2, 15)]
    assert [data[r.first_byte : r.first_byte + r.n_bytes] for r in rows] == [b"ab", b"ca", b"bc"] * 3
    cues = M.cue_table(media).collect()
    assert [(c.track, c.timestamp_ns, c.packet, c.cluster_byte) for c in cues] == [(2, 10_000_000, 6, len(M._HEAD) + 4 + len(M.vint(len(data) - len(M._HEAD) - 5)))] * 2


def test_incomplete_tracks_and_null_files(spark):
    tracks = M.element(M.TRACKS, M.element(M.ENTRY, M.number(M.NUMBER, 1) + M.number(M.KIND, 2)))
    depth = M.element(M.TRACKS, M.element(M.ENTRY, M.number(M.NUMBER, 1) + M.number(M.KIND, 2) + M.element(M.CODEC, b"\xff") + M.element(M.AUDIO, M.element(M.RATE, b"abc"))))
    rows = [(1, bytearray(M._HEAD + M.element(M.SEGMENT, tracks))), (2, None), (3, bytearray(M._HEAD + M.element(M.SEGMENT, depth))), (4, bytearray(M.write(bytes(64)))), (4, bytearray(M.write(bytes(64))))]
    for bad in (rows[0], rows[2]):
        with pytest.raises(M.Broken):
            M.parse(bytes(bad[1]))
    media = spark.createDataFrame(rows, "doc_id long, media binary")
    out = [(r.doc_id, r.payload_bytes) for r in M.read_back(media, ("doc_id",), strict=False).collect()]
    assert sorted(out, key=str) == sorted([(1, None), (2, None), (3, None), (4, 64), (4, 64)], key=str)
    assert M.packet_table(media, strict=False).count() == 2 == M.cue_table(media, strict=False).count()
    assert M.read_back(media.where("doc_id = 2"), ("doc_id",)).first().feature is None
    assert M.packet_table(media.limit(0)).count() == 0


def test_features_against_brute_force(spark):
    texts = ["", "abc", "é" * 700, "x" * 70_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in M.read_back(M.store(docs)).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        frames = -(-len(payload) // 512)
        clusters = -(-frames // (8 * 16))
        assert r.feature == f"packets={frames};clusters={clusters};cued={clusters};duration_ms={len(payload) / 8:.3f};mean={sum(payload) / len(payload):.4f};peak={max(payload)}"
