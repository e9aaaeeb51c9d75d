"""Queries over keys of 65,536 and more, which the SQL's hashes (of at most three bytes) don't cover, against plain loops."""

import random
from bisect import bisect_left

import pytest

from tidelog.functions.hashing import murmur3_of
from tidelog.functions.msgpack import pack
from tidelog.plans import queries as engine

_EDGES = (0, 1, 127, 128, 255, 256, 257, 65535, 65536, 65792, 149999, 8999999, (1 << 32) - 1, 1 << 32, (1 << 63) - 1)
KEYS = sorted({*_EDGES, *random.Random(2).sample(range(1 << 24), 60)})
HASH = {k: murmur3_of(pack(k)) for k in KEYS}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame([(k,) for k in KEYS], "o_orderkey long").coalesce(1).write.parquet(f"{path}/orders.parquet")
    return path


def rows(spark, folder, name, *columns):
    return sorted((tuple(r) for r in engine.queries()[name](spark, folder).select(*columns).collect()), key=repr)


def placed(key, rf, nodes="abc"):
    """(node, shard) of each replica: clockwise from the key's hash, the first shard of each node."""
    ring = sorted((murmur3_of(f"{n}-{i}".encode()), n, f"{n}-{i}") for n in nodes for i in (0, 1))
    at = bisect_left([h for h, _, _ in ring], HASH[key])
    found = {}
    for _, node, shard in (ring[at:] + ring[:at]):
        found.setdefault(node, shard)
    return list(found.items())[:rf]


def test_key_hash(spark, folder):
    assert rows(spark, folder, "key_hash", "o_orderkey", "key_hash") == sorted(HASH.items(), key=repr)
    assert HASH[257] != HASH[65792] and HASH[65536] == murmur3_of(b"\xce\x00\x01\x00\x00")


def test_hash_range_scan(spark, folder):
    want = [(k, h) for k, h in HASH.items() if h > 3_000_000_000 or h <= 500_000_000]
    assert rows(spark, folder, "hash_range_scan", "o_orderkey", "key_hash") == sorted(want, key=repr)


def test_owner_shard(spark, folder):
    want = [(k, *placed(k, 1)[0]) for k in KEYS]
    assert rows(spark, folder, "owner_shard", "o_orderkey", "node", "shard") == sorted(want, key=repr)


def test_replica_placement(spark, folder):
    want = [(k, i, *r) for k in KEYS for i, r in enumerate(placed(k, 2))]
    assert rows(spark, folder, "replica_placement", "o_orderkey", "replica_index", "node", "shard") == sorted(want, key=repr)


def moves(before, after):
    """(key, action, from, to): new replicas from the first of before that is still there, what is no longer placed deleted."""
    alive, out = {f"{n}-{i}" for n in after for i in (0, 1)}, []
    for k in KEYS:
        was, now = ([s for _, s in placed(k, 2, nodes)] for nodes in (before, after))
        source = next((s for s in was if s in alive), None)
        out += [(k, "send" if source else "lost", source, s) for s in now if s not in was]
        out += [(k, "delete", s, None) for s in was if s in alive and s not in now]
    return sorted(out, key=repr)


def test_migrate_on_death(spark, folder):
    assert rows(spark, folder, "migrate_on_death", "o_orderkey", "action", "from_shard", "to_shard") == moves("abc", "ab")


def test_migrate_on_join(spark, folder):
    assert rows(spark, folder, "migrate_on_join", "o_orderkey", "action", "from_shard", "to_shard") == moves("bc", "abc")


def test_last_owning_shard(spark, folder):
    want = [(k, placed(k, 3)[2][1]) for k in KEYS]
    assert rows(spark, folder, "last_owning_shard", "o_orderkey", "shard") == sorted(want, key=repr)


def test_owned_keys(spark, folder):
    want = [(k,) for k in KEYS if placed(k, 2)[1][1] == "b-1"]
    assert rows(spark, folder, "owned_keys", "o_orderkey") == sorted(want, key=repr)


def test_shard_load(spark, folder):
    first, both = [placed(k, 2)[0][1] for k in KEYS], [s for k in KEYS for _, s in placed(k, 2)]
    want = [(n, s, first.count(s), both.count(s)) for n in "abc" for s in (f"{n}-0", f"{n}-1")]
    assert rows(spark, folder, "shard_load", "node", "shard", "owned", "replicas") == sorted(want, key=repr)


def test_stored_hash_range(spark, folder):
    want = [(k, h) for k, h in HASH.items() if 1_000_000_000 < h <= 1_500_000_000]
    assert rows(spark, folder, "stored_hash_range", "o_orderkey", "key_hash") == sorted(want, key=repr)


def test_migrate_apply(spark, folder):
    made = moves("bc", "abc")
    want = [(k, s, False) for k in KEYS for _, s in placed(k, 2, "bc")]
    want += [(k, to, False) for k, action, _, to in made if action == "send"] + [(k, at, True) for k, action, at, _ in made if action == "delete"]
    assert rows(spark, folder, "migrate_apply", "o_orderkey", "shard", "is_tombstone") == sorted(want, key=repr)
