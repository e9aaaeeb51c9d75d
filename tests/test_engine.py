"""The engine's operators on small tables: ties, deletes, edges, and laws of merging."""

import random

import pytest
from pyspark.sql import functions as F

from tidelog import errors
from tidelog.api import Consistency, Engine
from tidelog.functions.hashing import murmur3, murmur3_of
from tidelog.functions.msgpack import F32, pack
from tidelog.operators import compaction, control, layout, lww, migration, replication, ring, scan, stats
from tidelog.sources.oplog import SCHEMA, checked


def log_of(spark, rows):
    """rows: (key, data or None, ts, seq, container)."""
    made = [("c", bytearray(pack(k)), 0, bytearray(d or b""), d is None, t, s, "a", "a-0", c) for k, d, t, s, c in rows]
    return spark.createDataFrame(made, SCHEMA)


def state(df):
    return {(bytes(r.key), bytes(r.data), r.is_tombstone, r.ts_nanos, r.seq) for r in df.collect()}


def test_newest_wins(spark):
    log = log_of(spark, [(1, b"old", 5, 0, 0), (1, b"new", 9, 1, 0), (1, b"late", 7, 2, 2), (2, b"x", 3, 3, 0), (2, b"tie", 3, 4, 2), (3, b"x", 1, 5, 0), (3, None, 2, 6, 2), (4, None, 1, 7, 0), (4, b"back", 2, 8, 2), (5, None, 1, 9, 0)])
    live = {bytes(r.key): bytes(r.data) for r in lww.live(log).collect()}
    assert live == {pack(1): b"new", pack(2): b"tie", pack(4): b"back"}
    assert lww.latest(log).count() == 5
    first = {bytes(r.key): bytes(r.data) for r in lww.of_newest_container(log).collect()}
    assert first[pack(1)] == b"late"
    assert scan.point(log, pack(3)).count() == 0 and scan.point(log, pack(9)).count() == 0
    assert scan.key_range(log, pack(2), pack(4)).count() == 4
    assert lww.live(log.limit(0)).count() == 0


def test_keys_are_bytes(spark):
    log = log_of(spark, [(1, b"int", 1, 0, 0), (1.0, b"double", 1, 1, 0), ("1", b"string", 1, 2, 0), (F32(1), b"single", 1, 3, 0)])
    assert lww.live(log).count() == 4


@pytest.mark.parametrize("seed", range(3))
def test_laws_of_merging(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(12), rng.choice([None, b"v%d" % s]), rng.randrange(6), s, 2 * rng.randrange(4)) for s in range(80)]
    log = log_of(spark, rows)
    want = state(lww.live(log))
    assert state(lww.live(log.unionByName(log))) == want
    assert state(lww.live(compaction.compact(log))) == want
    for part in ([0, 2], [4], [0, 2, 4, 6]):
        assert state(lww.live(compaction.compact(log, part, output=9))) == want
    twice = compaction.compact(compaction.compact(log, [0, 2], output=1), [1, 4], output=3)
    assert state(lww.live(twice)) == want


def test_partial_compaction_keeps_tombstones(spark):
    log = log_of(spark, [(1, b"x", 1, 0, 0), (1, None, 2, 1, 2), (2, b"y", 1, 2, 4)])
    part = compaction.compact(log, [2, 4], output=1)
    assert lww.live(part).count() == 1 and part.where("is_tombstone").count() == 1
    assert compaction.compact(log_of(spark, [(1, None, 1, 0, 0)])).count() == 0


def test_three_containers_with_deletes(spark):
    rows = [(n, b"d", n, n, n // 32 * 2) for n in range(94)] + [(1, None, 94, 94, 4), (4, None, 95, 95, 4)]
    log = log_of(spark, rows)
    between = scan.key_range(log, pack(1), pack(5))
    assert between.count() == 6
    merged = compaction.compact(log, output=5)
    assert merged.count() == 92 and {bytes(r.key) for r in scan.key_range(merged, pack(1), pack(5)).collect()} == {pack(2), pack(3)}


def cascade(sizes, factor):
    """The plan of one collection, container by container."""
    tiers = {}
    for c, n in sizes.items():
        tiers.setdefault(n.bit_length() - 1, []).append(c)
    group, carried, to = {t: t for t in tiers}, 0, None
    for t in sorted(tiers):
        total = sum(sizes[c] for c in tiers[t]) + (carried if to == t else 0)
        reach = total.bit_length() - 1
        to, carried = (reach, total) if reach > t else (None, 0)
        if to in tiers:
            group[t] = to

    def end(t):
        while group[t] != t:
            t = group[t]
        return t

    out = {}
    for t in tiers:
        out.setdefault(end(t), set()).update(tiers[t])
    return {(t, c) for t, cs in out.items() if len(cs) >= max(2, factor) for c in cs}


@pytest.mark.parametrize("seed", range(4))
def test_compaction_plan(spark, seed):
    rng = random.Random(seed)
    sizes = {2 * k: rng.choice([1, 2, 3, 7, 8, 100, 1000, 5000]) for k in range(rng.randrange(1, 14))}
    rows = spark.createDataFrame([("c", c, n) for c, n in sizes.items()], "collection string, container_id int, entries bigint")
    for factor in (2, 3):
        assert {(r.tier, r.container_id) for r in compaction.candidates(rows, factor).collect()} == cascade(sizes, factor)
    assert compaction.candidates(rows, 1).count() == 0


def test_layout(spark):
    log = log_of(spark, [(k, b"d" * n, 0, k, 0) for k, n in enumerate([0 + 1, 4063, 4064, 5000])])
    rows = {r.seq: r for r in layout.offsets(layout.wal_records(log)).collect()}
    assert [rows[k].full_size for k in range(4)] == [34, 4096, 4097, 5033]
    assert [rows[k].wal_bytes for k in range(4)] == [4096, 8192, 8192, 8192]
    assert [rows[k].offset for k in range(4)] == [0, 34, 4130, 8227] and [rows[k].index_offset for k in range(4)] == [0, 16, 32, 48]
    log = log_of(spark, [(k % 3 if k < 9 else k, b"d", 0, k, 0) for k in range(14)])
    assert [r.container_id for r in layout.flush(log, 3).orderBy("seq").collect()] == [0] * 9 + [2, 2, 2, 4, 4]


def nodes(spark, names, shards=1):
    return ring.ring(spark.createDataFrame([(n, list(range(shards))) for n in names], "node string, ids array<int>"))


def keys(spark, names=("KEY", "key")):
    df = spark.createDataFrame([("c", n, bytearray(pack(n))) for n in names], "collection string, name string, key binary")
    return df.withColumn("key_hash", murmur3(F.col("key")))


def test_placement_of_known_keys(spark):
    for names, want in (("abc", {"KEY": "bc", "key": "ca"}), ("ab", {"KEY": "ba", "key": "ab"}), ("bc", {"KEY": "bc", "key": "cb"})):
        got = {}
        for r in ring.placement(keys(spark), nodes(spark, names), 2).orderBy("replica_index").collect():
            got[r.name] = got.get(r.name, "") + r.node
        assert got == want


def test_placement_laws(spark, monkeypatch):
    many = keys(spark, [f"k{k}" for k in range(300)])
    placed = ring.placement(many, nodes(spark, "abcd", 3), 3)
    counts = placed.groupBy("name").agg(F.countDistinct("node").alias("n"), F.count("*").alias("r")).collect()
    assert len(counts) == 300 and all((c.n, c.r) == (3, 3) for c in counts)
    assert ring.placement(many, nodes(spark, "ab"), 5).count() == 600
    sliced = {(r.name, r.replica_index, r.shard) for r in placed.collect()}
    monkeypatch.setattr(ring, "MOST_SHARDS", 2)
    assert {(r.name, r.replica_index, r.shard) for r in ring.placement(many, nodes(spark, "abcd", 3), 3).collect()} == sliced
    r = nodes(spark, "abc")
    edges = spark.createDataFrame([(h,) for x in r.collect() for h in (x.hash, (x.hash + 1) % (1 << 32))] + [(0,), ((1 << 32) - 1,)], "key_hash long")
    owner = {x.key_hash: x.shard for x in ring.placement(edges, r).collect()}
    assert all(owner[x.hash] == x.shard for x in r.collect()) and len(owner) == 8
    assert [x.shard for x in ring.rotated(r, "c-0").collect()] == ["c-0", "a-0", "b-0"]


@pytest.mark.parametrize("before,after", [("abc", "ab"), ("bc", "abc"), ("abcd", "bcd")])
def test_migration_gives_the_placement_after(spark, before, after):
    many = keys(spark, [f"k{k}" for k in range(120)] + ["KEY", "key"])
    was, now = nodes(spark, before, 2), nodes(spark, after, 2)
    moves = migration.plan(many.select("collection", "key", "key_hash"), was, now, 2)
    alive = [r.shard for r in now.collect()]
    stored = ring.placement(many, was, 2).where(F.col("shard").isin(alive)).select("collection", "key", "key_hash", "shard")
    got = {(bytes(r.key), r.shard) for r in migration.apply(stored, moves).collect()}
    assert got == {(bytes(r.key), r.shard) for r in ring.placement(many, now, 2).collect()}
    assert moves.where("action = 'lost'").count() == 0
    lost = migration.plan(many, nodes(spark, "x"), nodes(spark, "y"), 1)
    assert {r.action for r in lost.collect()} == {"lost"}


def test_replicas(spark):
    rows = [("c", 1, 5, 0, "a", 0), ("c", 1, 9, 1, "b", 1), ("c", 1, 9, 1, "c", 2), ("c", 2, 4, 2, "b", 1)]
    answers = spark.createDataFrame(rows, "collection string, key int, ts_nanos long, seq long, node string, replica_index int")
    assert {(r.key, r.node) for r in replication.reconcile(answers, local="c").collect()} == {(1, "c"), (2, "b")}
    got = {r.key: (r.ts_nanos, r.answered, r.acks_met) for r in replication.read(answers, 1).collect()}
    assert got == {1: (5, 1, True), 2: (4, 1, True)}  # a silent replica is passed over
    assert {(r.key, r.node, r.behind_nanos) for r in replication.stale(answers).collect()} == {(1, "a", 4)}
    assert [Consistency.QUORUM.needed(n) for n in (1, 2, 3, 4, 5)] == [1, 2, 2, 3, 3]
    assert Consistency.fixed(7).needed(3) == 3 and Consistency.ALL.needed(4) == 4
    with pytest.raises(ValueError):
        Consistency.fixed(0)


def test_first_answers_and_ties(spark):
    rows = [("c", 1, 9, 1, "b", 1), ("c", 1, 9, 1, "c", 2), ("c", 2, 5, 1, "a", 0), ("c", 2, 5, 1, "b", 1), ("c", 2, 7, 1, "c", 2), ("c", 3, 5, 4, "a", 0), ("c", 3, 5, 6, "b", 1)]
    answers = spark.createDataFrame(rows, "collection string, key int, ts_nanos long, seq long, node string, replica_index int").repartition(3)
    got = {r.key: (r.node, r.answered, r.acks_met) for r in replication.read(answers, 2).collect()}
    assert got == {1: ("b", 2, True), 2: ("a", 2, True), 3: ("b", 2, True)}  # replica 0 is silent on 1; ties: arrival, then the first
    got = {r.key: (r.node, r.answered, r.acks_met) for r in replication.read(answers, 2, local="c").collect()}
    assert got == {1: ("c", 2, True), 2: ("c", 2, True), 3: ("b", 2, True)}
    assert {r.key: r.acks_met for r in replication.read(answers, 3).collect()} == {1: False, 2: True, 3: False}
    assert {r.key: r.node for r in replication.reconcile(answers).collect()} == {1: "c", 2: "c", 3: "b"}


def test_consistency(spark, tmp_path):
    """What is written while a node is down is read where a quorum met, and not on the node that missed it."""
    three = {"a": 2, "b": 2, "c": 2}
    whole = Engine(spark, f"file://{tmp_path}", three, 3)
    mine = whole.create_collection("t")
    walk = [n for n, _ in whole.walk(0, 3)]
    assert sorted(walk) == ["a", "b", "c"]
    key = next(k for k in range(100) if [n for n, _ in whole.walk(murmur3_of(pack(k)), 3)][0] == "a")
    order = mine.answering(key)
    assert mine.set(key, "old", Consistency.ALL) == {"acks": 3, "needed": 3, "acks_met": True}
    without = Engine(spark, whole.root, three, 3, down=("a",)).collection("t")
    assert without.set(key, "new", Consistency.QUORUM) == {"acks": 2, "needed": 2, "acks_met": True}
    assert without.set(key, "new", Consistency.ALL)["acks_met"] is False
    assert mine.get_value(key) == "old" and mine.get_value(key, Consistency.QUORUM) == "new" == mine.get_value(key, Consistency.ALL)
    assert without.get_value(key) == "new" and mine.get_value(key, replica_index=1) == "new"
    one = Engine(spark, whole.root, three, 3, down=tuple(order[:2])).collection("t")
    one.delete(key)
    with pytest.raises(errors.KeyNotFound):
        one.get_value(key)
    assert mine.get_value(key) == "old" and mine.get_value(key, Consistency.QUORUM) == "new"
    mine.compact()  # as every replica would merge its own
    assert mine.get_value(key) == "old" and mine.get_value(key, Consistency.QUORUM) == "new"
    with pytest.raises(errors.KeyNotFound):
        mine.get_value(key, Consistency.ALL)
    mine.delete(key, Consistency.ALL)
    mine.compact()
    assert mine.raw_log().count() == 0
    with pytest.raises(errors.Timeout):
        Engine(spark, whole.root, three, 3, down=("a", "b", "c")).collection("t").get(key)
    assert whole.request({"type": "set", "collection": "t", "key": key, "value": 5, "consistency": 2}) == "OK"
    assert whole.request({"type": "get", "collection": "t", "key": key, "consistency": 3, "replica_index": 1}) == 5


def test_messages_of_replicas(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}", {"a": 1, "b": 1}, 2)
    with pytest.raises(errors.CollectionNotFound):
        engine.apply("set", "none", "k", 1, 5)
    assert engine.apply("delete", "none", "k", ts_nanos=5) is None and engine.apply("get", "none", "k") is None
    engine.create_collection("t")
    engine.apply("set", "t", "k", 1, 5, "a")
    engine.apply("set", "t", "k", 2, 4, "a")
    assert engine.apply("get", "t", "k", node="a")["ts_nanos"] == 5 and engine.apply("get", "t", "k", node="b") is None
    engine.apply("delete", "t", "k", ts_nanos=9, node="a")
    assert engine.apply("get", "t", "k", node="a")["is_tombstone"]
    with pytest.raises(errors.UnsupportedField):
        engine.apply("merge", "t", "k")
    assert engine.route("t") in ("a-0", "b-0")


def test_walks_of_any_ring(spark, monkeypatch):
    """Against the walk of one key; with one near shard a replica, walks take the whole ring."""
    names = {"a": 9, "b": 1, "c": 2}
    engine = Engine(spark, "file:///nowhere", names)
    many = keys(spark, [f"k{k}" for k in range(80)])
    for near in (8, 1):
        monkeypatch.setattr(ring, "NEAR", near)
        for rf in (1, 2, 3, 5):
            got = {}
            for r in ring.placement(many, engine.ring(), rf).orderBy("replica_index").collect():
                got.setdefault(r.key_hash, []).append((r.node, r.shard))
            assert got == {h: engine.walk(h, rf) for h in got} and len(got) == 80


def test_tiers_are_compacted(spark, tmp_path):
    mine = Engine(spark, f"file://{tmp_path}").create_collection("t")
    rows = lambda a, b: spark.range(a, b).selectExpr("cast(cast(id as string) as binary) as key", "cast('v' as binary) as data").coalesce(1)
    mine.set_many(rows(0, 1000))
    for k in range(3):
        mine.set_many(rows(10 * k, 10 * k + 10))
    mine.delete_many(rows(5, 6))
    was = mine.store.manifest()["containers"]
    mine.compact_tiers(2)
    now = mine.store.manifest()["containers"]
    assert was[0] in now and sorted(c["entries"] for c in now) == [1, 30, 1000]  # the large one isn't rewritten
    assert mine.live().count() == 999


def test_stored_files_hold_ranges_of_hashes(spark, tmp_path):
    mine = Engine(spark, f"file://{tmp_path}").create_collection("t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        mine.set_many(spark.range(5000).selectExpr("cast(cast(id as string) as binary) as key", "cast('v' as binary) as data").repartition(4))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    spans = mine.raw_log().groupBy(F.input_file_name()).agg(F.min("key_hash").alias("a"), F.max("key_hash").alias("b")).orderBy("a").collect()
    assert len(spans) > 1 and all(x.b < y.a for x, y in zip(spans, spans[1:]))


def test_bloom_filters_are_written_by_large_compactions(spark, tmp_path):
    import pathlib

    mine = Engine(spark, f"file://{tmp_path}").create_collection("t")
    mine.set_many(spark.range(20_000).selectExpr("cast(cast(id as string) as binary) as key", "cast(repeat('v', 60) as binary) as data"))
    mine.compact()
    folder = mine.store.manifest()["containers"][0]["folder"]
    files = list(pathlib.Path(tmp_path).rglob(f"{folder}/*.parquet"))
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    offsets = []
    for f in files:
        path = jvm.org.apache.hadoop.fs.Path(f"file://{f}")
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(path, conf))
        column = next(c for c in reader.getFooter().getBlocks().get(0).getColumns() if c.getPath().toDotString() == "key")
        offsets.append(column.getBloomFilterOffset())
        reader.close()
    assert files and all(o > 0 for o in offsets)
    assert mine.get(5).count() == 0 and mine.raw_log().where(F.col("key") == F.lit(bytearray(b"77"))).count() == 1


def test_one_of_two_writers_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from tidelog.sources.store import Files

    files = Files(spark, f"file://{tmp_path}")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: files.create(f"file://{tmp_path}/m", str(k)), range(8)))
    assert sum(won) == 1 and files.read(f"file://{tmp_path}/m") == str(won.index(True)) and files.names(f"file://{tmp_path}") == ["m"]


def test_percentiles_of_any_numbers(spark):
    rng = random.Random(9)
    values = [rng.choice([0.0, -0.0, rng.uniform(-5, 5), rng.lognormvariate(0, 9), -rng.lognormvariate(0, 3), 1e300, -1e-300]) for _ in range(3000)]
    r = stats.latency(spark.createDataFrame([("x", v) for v in values] + [("y", 7.0), ("x", None)], "op string, v double"), "v").where("op = 'x'").first()
    s = sorted(values)
    assert [r.n, r.min, r.max] == [3000, s[0], s[-1]] and [r.p50, r.p90, r.p99, r.p999] == [s[2999 * a // b] for a, b in ((5, 10), (9, 10), (99, 100), (999, 1000))]
    nanos = [rng.randrange(10**9) for _ in range(2000)]
    r = stats.latency(spark.createDataFrame([("x", v) for v in nanos], "op string, v long"), "v").first()
    assert r.p99 == sorted(nanos)[1999 * 99 // 100] and r.total == sum(nanos)


def test_offsets_of_any_keys(spark):
    """Running sums over buckets of keys, however the keys lie."""
    rng = random.Random(3)
    for names in ([b""], [b"k", b"k\0", b"k\0\0"], [b"user:%06d" % rng.randrange(10**6) for _ in range(400)], [rng.randbytes(rng.randrange(12)) for _ in range(400)]):
        rows = [("c", bytearray(k), 0, bytearray(b"d" * rng.randrange(9)), False, rng.randrange(3), s, "a", "a-0", s % 2) for s, k in enumerate(names)]
        got = {(r.container_id, r.seq): (r.offset, r.index_offset) for r in layout.offsets(spark.createDataFrame(rows, SCHEMA)).collect()}
        want, at = {}, {}
        for r in sorted(rows, key=lambda r: (r[9], bytes(r[1]), r[5], r[6])):
            n, size = at.get(r[9], (0, 0))
            want[r[9], r[6]] = (size, 16 * n)
            at[r[9]] = (n + 1, size + 32 + len(r[1]) + len(r[3]))
        assert got == want
    log = log_of(spark, [(k, b"d" * (k % 7), 0, k * 9000, 0) for k in range(50)])
    rows = layout.wal_records(log).orderBy("seq").collect()
    assert [r.wal_offset for r in rows] == [4096 * k for k in range(50)]


def test_gossip_expires(spark):
    second = 10**9
    times = [0, 1, 2, 3, 10, 32, 33, 34, 40]
    events = spark.createDataFrame([("n", "Alive", "p", t * second) for t in times], "source string, kind string, payload string, ts_nanos long")
    rows = control.gossip_with_expiry(events).orderBy("ts_nanos").collect()
    assert [r.seen for r in rows] == [1, 2, 3, 4, 4, 4, 1, 2, 3] and [r.handled for r in rows].count(True) == 2
    dead = spark.createDataFrame([("x", "Dead", "a", 5), ("x", "Dead", "b", 6), ("x", "Alive", "a", 7)], "source string, kind string, payload string, ts_nanos long")
    assert [tuple(r) for r in control.self_announcements(dead, spark.createDataFrame([("a",)], "node string")).collect()] == [("a", "Alive", "a", 5)]
    names = spark.createDataFrame([(f"n{k}",) for k in range(9)], "node string")
    drawn = control.fanout(names, names, 3, 1).collect()
    assert len(drawn) == 27 and all(r.source != r.node for r in drawn) and sorted(map(tuple, drawn)) == sorted(map(tuple, control.fanout(names, names, 3, 1).collect()))
    files = spark.createDataFrame([("12.data",), ("x12.data",), ("12.data.tmp",), ("7.index",)], "name string")
    assert [(r.name, r.container_id) for r in layout.container_files(files, "data").collect()] == [("12.data", 12)]


def test_statistics(spark):
    rng = random.Random(4)
    for n in (1, 2, 10, 999, 1000, 1001):
        values = [float(rng.randrange(50)) for _ in range(n)]
        r = stats.latency(spark.createDataFrame([("get", v) for v in values], "op string, v double"), "v").first()
        s = sorted(values)
        assert (r.n, r.total, r.min, r.max) == (n, sum(s), s[0], s[-1])
        assert [r.p50, r.p90, r.p99, r.p999] == [s[(n - 1) * a // b] for a, b in ((5, 10), (9, 10), (99, 100), (999, 1000))]


def test_gossip(spark):
    events = spark.createDataFrame([("n", "CreateCollection", f"c{k % 2}", k) for k in range(5)], "source string, kind string, payload string, ts_nanos long")
    rows = control.gossip_counts(events).orderBy("ts_nanos").collect()
    assert [(r.handled, r.forwarded) for r in rows] == [(True, True), (False, True), (False, True), (False, False), (False, False)]
    assert {r.name for r in control.collections(control.distinct_events(events)).collect()} == {"c0", "c1"}


def test_engine_end_to_end(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/db", {"a": 2, "b": 1}, 1)
    with pytest.raises(errors.CollectionNotFound):
        engine.collection("test")
    ask = engine.request
    assert ask({"type": "create_collection", "name": "test", "replication_factor": 2}) == "OK"
    with pytest.raises(errors.CollectionAlreadyExists):
        engine.create_collection("test")
    assert ask({"type": "get_collection", "name": "test"}) == {"replication_factor": 2}
    get = {"type": "get", "collection": "test", "key": "key"}
    with pytest.raises(errors.KeyNotFound):
        ask(get)
    assert ask({"type": "set", "collection": "test", "key": "key", "value": F32(100)}) == "OK"
    assert ask(get) == 100.0 and Engine(spark, engine.root).request(get) == 100.0
    ask({"type": "set", "collection": "test", "key": "doc", "value": {"is": True, "owner": "x"}})
    ask({"type": "delete", "collection": "test", "key": "absent"})
    ask({"type": "delete", "collection": "test", "key": "key"})
    mine = engine.collection("test")
    with pytest.raises(errors.KeyNotFound):
        ask(get)
    assert mine.entries().count() == 3 and mine.live().count() == 1
    plan = {r.container_id for r in mine.compaction_plan().collect()}
    assert plan == {0, 2, 4, 6}
    assert [c["id"] for c in mine.compact([0, 2])["containers"]] == [4, 6, 1]
    assert [c["entries"] for c in mine.compact()["containers"]] == [1]
    ask({"type": "set", "collection": "test", "key": "key", "value": 1})
    assert ask(get) == 1 and max(c["id"] for c in mine.store.manifest()["containers"]) == 8
    mine.vacuum()
    assert ask({"type": "get", "collection": "test", "key": "doc"}) == {"is": True, "owner": "x"}
    asked = spark.createDataFrame([(bytearray(pack(k)),) for k in ("key", "none")], "key binary")
    assert {bytes(r.key): r.found for r in mine.get_many(asked).collect()} == {pack("key"): True, pack("none"): False}
    assert mine.replicated().select("node").distinct().count() == 2
    assert mine.scan(key_range=(pack("key"), None), where=~F.col("is_tombstone")).count() == 1
    meta = ask({"type": "get_cluster_metadata"})
    assert meta["collections"] == {"test": 2} and [n["node"] for n in meta["nodes"]] == ["a", "b"]
    owner = engine.placement(asked.limit(1)).first().shard
    assert ask(get | {"shard": owner}) == 1
    with pytest.raises(errors.KeyNotOwnedByShard):
        ask(get | {"shard": next(r.shard for r in engine.ring().collect() if r.shard != owner)})
    assert engine.migration_plan(asked, {"z": 1}).count() == 2
    ask({"type": "drop_collection", "name": "test"})
    with pytest.raises(errors.CollectionNotFound):
        ask(get)


@pytest.mark.parametrize("request_,error", [
    ([], errors.BadFieldType), ({}, errors.MissingField), ({"type": 5}, errors.BadFieldType), ({"type": "upsert"}, errors.UnsupportedField),
    ({"type": "get_collection"}, errors.MissingField), ({"type": "get_collection", "name": 3}, errors.BadFieldType),
    ({"type": "set", "collection": "t", "key": None, "value": 1}, errors.MissingField), ({"type": "set", "collection": "t", "key": 1, "value": None}, errors.MissingField),
    ({"type": "get", "collection": "t", "key": 1, "consistency": 0}, errors.BadFieldType),
])
def test_bad_requests(spark, tmp_path, request_, error):
    engine = Engine(spark, f"file://{tmp_path}")
    engine.create_collection("t")
    with pytest.raises(error):
        engine.request(request_)


def test_rows_without_key_or_value(spark):
    for row in ((None, bytearray(b"x")), (bytearray(b"k"), None), (bytearray(b"k"), bytearray(b""))):
        log = spark.createDataFrame([row], "key binary, data binary").withColumn("is_tombstone", F.lit(False))
        with pytest.raises(Exception, match="MissingField"):
            checked(log).collect()


def test_two_writers(spark, tmp_path):
    mine = Engine(spark, f"file://{tmp_path}").create_collection("t")
    was = mine.store.manifest()
    mine.set("a", 1)
    with pytest.raises(errors.VersionConflict):
        mine.store.commit(was, [])


def test_stream_batches_count_once(spark, tmp_path):
    from tidelog.streaming.upsert import upsert

    source = f"{tmp_path}/in"
    for k in range(3):
        rows = spark.createDataFrame([(bytearray(pack(i)), bytearray(b"v%d" % k), i == k, 10 * k + i, 10 * k + i) for i in range(4)], "key binary, data binary, is_tombstone boolean, ts_nanos long, seq long")
        rows.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
    mine = Engine(spark, f"file://{tmp_path}/db").create_collection("t")
    upsert(stream, mine, f"{tmp_path}/cp", compact_every=2).awaitTermination()
    assert {bytes(r.key): bytes(r.data) for r in mine.live().collect()} == {pack(0): b"v2", pack(1): b"v2", pack(3): b"v2"}
    before = mine.store.manifest()
    mine.append(rows, ("upsert", 2))
    assert mine.store.manifest() == before
