"""The engine's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.msgpack import pack
from ..operators import compaction, control, layout, lww, migration, replication, ring, scan, stats
from . import demo

RF = 2
Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def shown(df: DataFrame, *more: str) -> DataFrame:
    """Entries without binary columns."""
    return df.select("user_id", F.decode("data", "UTF-8").alias("data"), "is_tombstone", "ts_nanos", "seq", *more)


# --- SQL that several queries share --------------------------------------------------------------------------------

LOG = """
log AS (
  SELECT user_id, CASE WHEN event_type = 'error' THEN '' ELSE event_type || ':' || coalesce(props, '') END AS data,
         event_type = 'error' AS is_tombstone, (epoch_us(ts) * 1000)::BIGINT AS ts_nanos, event_id AS seq,
         (2 * (event_id // 1000))::INTEGER AS container_id, ['a', 'b', 'c'][(event_id % 3)::INTEGER + 1] AS node,
         CASE WHEN user_id < 128 THEN 1 WHEN user_id < 256 THEN 2 WHEN user_id < 65536 THEN 3 ELSE 5 END AS key_bytes,
         CASE WHEN user_id < 128 THEN lower(printf('%02x', user_id)) WHEN user_id < 256 THEN 'cc' || lower(printf('%02x', user_id))
              WHEN user_id < 65536 THEN 'cd' || lower(printf('%04x', user_id)) ELSE 'ce' || lower(printf('%08x', user_id)) END AS key_hex
  FROM events)"""
ENTRY = "user_id, data, is_tombstone, ts_nanos, seq"
LATEST = f"{LOG}, latest AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_nanos DESC, seq DESC) = 1)"


def _rotl(x: str, r: int) -> str:
    return f"((({x})::HUGEINT * {1 << r}) % 4294967296 + ({x})::HUGEINT // {1 << 32 - r})::BIGINT"


def _mul(x: str, c: int) -> str:
    return f"((({x})::HUGEINT * {c}) % 4294967296)::BIGINT"


def murmur_sql(source: str, columns: str) -> str:
    """CTEs that end in ``hashed`` (columns, key_hash) of keys ``source`` (columns, k: a whole number below 65536)."""
    return f"""
m0 AS (SELECT {columns}, CASE WHEN k < 128 THEN k WHEN k < 256 THEN 204 + k * 256 ELSE 205 + (k // 256) * 256 + (k % 256) * 65536 END AS t,
              CASE WHEN k < 128 THEN 1 WHEN k < 256 THEN 2 ELSE 3 END AS n FROM {source}),
{mix_sql("m0", columns)}"""


def mix_sql(source: str, columns: str) -> str:
    """CTEs that end in ``hashed`` of ``source`` (columns, t: up to three bytes as a little-endian number, n: how many)."""
    return f"""
m1 AS MATERIALIZED (SELECT {columns}, n, {_mul("t", 3432918353)} AS x FROM {source}),
m2 AS MATERIALIZED (SELECT {columns}, n, {_rotl("x", 15)} AS x FROM m1),
m3 AS MATERIALIZED (SELECT {columns}, xor({_mul("x", 461845907)}, n::BIGINT) AS x FROM m2),
m4 AS MATERIALIZED (SELECT {columns}, {_mul("xor(x, x >> 16)", 2246822507)} AS x FROM m3),
m5 AS MATERIALIZED (SELECT {columns}, {_mul("xor(x, x >> 13)", 3266489909)} AS x FROM m4),
hashed AS MATERIALIZED (SELECT {columns}, xor(x, x >> 16) AS key_hash FROM m5)"""


def string_hash_sql() -> str:
    """CTEs that end in ``named`` (c_name, key_hash) of customers, whose names have 18 bytes: with their head byte, four blocks
    of four bytes and three more."""
    ctes = ["b AS MATERIALIZED (SELECT c_name, list_prepend(178, list_transform(range(1, 19), lambda i: ascii(substr(c_name, i, 1))))::BIGINT[] AS b, 0::BIGINT AS h FROM customer)"]
    last = "b"
    for k in range(4):
        block = " + ".join(f"b[{4 * k + j + 1}] * {1 << 8 * j}" for j in range(4))
        ctes += [
            f"s{k} AS MATERIALIZED (SELECT c_name, b, h, {_mul(block, 3432918353)} AS x FROM {last})",
            f"r{k} AS MATERIALIZED (SELECT c_name, b, h, {_rotl('x', 15)} AS x FROM s{k})",
            f"t{k} AS MATERIALIZED (SELECT c_name, b, xor(h, {_mul('x', 461845907)}) AS h FROM r{k})",
            f"h{k} AS MATERIALIZED (SELECT c_name, b, ({_rotl('h', 13)} * 5 + 3864292196) % 4294967296 AS h FROM t{k})",
        ]
        last = f"h{k}"
    ctes += [
        f"e1 AS MATERIALIZED (SELECT c_name, h, {_mul('b[17] + b[18] * 256 + b[19] * 65536', 3432918353)} AS x FROM {last})",
        f"e2 AS MATERIALIZED (SELECT c_name, h, {_rotl('x', 15)} AS x FROM e1)",
        f"e3 AS MATERIALIZED (SELECT c_name, xor(xor(h, {_mul('x', 461845907)}), 19::BIGINT) AS x FROM e2)",
        f"e4 AS MATERIALIZED (SELECT c_name, {_mul('xor(x, x >> 16)', 2246822507)} AS x FROM e3)",
        f"e5 AS MATERIALIZED (SELECT c_name, {_mul('xor(x, x >> 13)', 3266489909)} AS x FROM e4)",
        "named AS MATERIALIZED (SELECT c_name, xor(x, x >> 16) AS key_hash FROM e5)",
    ]
    return ",\n".join(ctes)


def ring_sql(nodes: str = "abc", name: str = "ring") -> str:
    """CTEs that end in ``name`` (hash, prev_hash, wraps, node, shard, shard_id)."""
    p = f"{name}_"
    ctes = f"""
names AS (SELECT node, id, node || '-' || id AS shard FROM (SELECT unnest([{", ".join(repr(n) for n in nodes)}]) AS node), (SELECT unnest([0, 1]) AS id)),
m0 AS (SELECT node, id, shard, ascii(node)::BIGINT + 45 * 256 + (48 + id)::BIGINT * 65536 AS t, 3 AS n FROM names),
{mix_sql("m0", "node, id, shard")}"""
    for k in ("names", "m0", "m1", "m2", "m3", "m4", "m5", "hashed"):
        ctes = ctes.replace(f"\n{k} AS", f"\n{p}{k} AS").replace(f"FROM {k}", f"FROM {p}{k}")
    return f"""{ctes},
{name} AS MATERIALIZED (
  SELECT key_hash AS hash, coalesce(lag(key_hash) OVER (ORDER BY key_hash), max(key_hash) OVER ()) AS prev_hash,
         lag(key_hash) OVER (ORDER BY key_hash) IS NULL AS wraps, node, shard, id::INTEGER AS shard_id FROM {p}hashed)"""


def replicas_sql(rf: int = RF, name: str = "ring") -> str:
    """A CTE ``name_replicas`` (prev_hash, hash, replica_index, node, shard)."""
    return f"""
{name}_ranked AS (SELECT *, row_number() OVER (ORDER BY hash) - 1 AS i, count(*) OVER () AS m FROM {name}),
{name}_walk AS MATERIALIZED (SELECT a.prev_hash, a.hash, b.node, b.shard, (b.i - a.i + a.m) % a.m AS step FROM {name}_ranked a, {name}_ranked b),
{name}_first AS (SELECT * FROM {name}_walk QUALIFY row_number() OVER (PARTITION BY hash, node ORDER BY step) = 1),
{name}_replicas AS MATERIALIZED (
  SELECT prev_hash, hash, replica_index, node, shard
  FROM (SELECT *, (row_number() OVER (PARTITION BY hash ORDER BY step) - 1)::INTEGER AS replica_index FROM {name}_first)
  WHERE replica_index < {rf})"""


IN_RING = "CASE WHEN r.prev_hash < r.hash THEN h.key_hash > r.prev_hash AND h.key_hash <= r.hash ELSE h.key_hash > r.prev_hash OR h.key_hash <= r.hash END"
ORDER_KEYS = f"keys AS (SELECT o_orderkey, o_orderkey AS k FROM orders), {murmur_sql('keys', 'o_orderkey')}"

# --- last write wins and reads -------------------------------------------------------------------------------------


@query(f"WITH {LATEST} SELECT {ENTRY} FROM latest WHERE NOT is_tombstone")
def live_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(lww.live(demo.events(spark, sf_dir)))


@query(f"WITH {LATEST} SELECT {ENTRY} FROM latest")
def latest_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(lww.latest(demo.events(spark, sf_dir)))


@query(f"WITH {LATEST} SELECT {ENTRY} FROM latest WHERE NOT is_tombstone AND user_id = 7")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan.point(demo.events(spark, sf_dir), pack(7)))


@query(f"""WITH {LATEST} SELECT a.c_custkey AS asked, l.user_id IS NOT NULL AND NOT l.is_tombstone AS found,
CASE WHEN NOT l.is_tombstone THEN l.data END AS data FROM (SELECT DISTINCT c_custkey FROM customer) a LEFT JOIN latest l ON l.user_id = a.c_custkey""")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.msgpack import encode_int

    asked = demo.table(spark, sf_dir, "customer").select(F.lit("events").alias("collection"), encode_int(F.col("c_custkey")).alias("key"), "c_custkey")
    found = scan.many(demo.events(spark, sf_dir), asked)
    return asked.dropDuplicates(["c_custkey"]).join(found, ["collection", "key"]).select(F.col("c_custkey").alias("asked"), "found", F.decode("data", "UTF-8").alias("data"))


@query(f"WITH {LOG} SELECT {ENTRY}, container_id FROM log")
def raw_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan.raw(demo.events(spark, sf_dir)), "container_id")


@query(f"WITH {LOG} SELECT {ENTRY} FROM log WHERE user_id >= 10 AND user_id < 60")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(scan.key_range(demo.events(spark, sf_dir), pack(10), pack(60)))


@query(f"WITH {LOG} SELECT {ENTRY} FROM log WHERE NOT is_tombstone AND starts_with(data, 'purchase') AND seq >= 5000")
def filtered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicate = ~F.col("is_tombstone") & F.decode("data", "UTF-8").startswith("purchase") & (F.col("seq") >= 5000)
    return shown(scan.filtered(demo.events(spark, sf_dir), predicate))


@query(f"WITH {ORDER_KEYS} SELECT o_orderkey, key_hash FROM hashed WHERE key_hash > 3000000000 OR key_hash <= 500000000")
def hash_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.hash_range(demo.order_keys(spark, sf_dir), 3_000_000_000, 500_000_000).select("o_orderkey", "key_hash")


def _stored(spark: SparkSession, sf_dir: str):
    """A collection of the orders, written to the shared folder; a key's data is its number."""
    import uuid

    from ..api import Engine
    from ..sources.store import shared_root

    mine = Engine(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}").create_collection("orders")
    mine.set_many(demo.order_keys(spark, sf_dir).select("key", F.encode(F.col("o_orderkey").cast("string"), "UTF-8").alias("data")))
    return mine


def _number() -> F.Column:
    return F.decode("data", "UTF-8").cast("long").alias("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey BETWEEN 256 AND 999")
def stored_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).scan(key_range=(pack(256), pack(1000))).select(_number())


@query(f"WITH {ORDER_KEYS} SELECT o_orderkey, key_hash FROM hashed WHERE key_hash > 1000000000 AND key_hash <= 1500000000")
def stored_hash_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).scan(hash_range=(1_000_000_000, 1_500_000_000)).select(_number(), "key_hash")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey = 321")
def stored_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(spark, sf_dir).get(321).select(_number())


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 3")
def recovered_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection with deletes after its tiers were merged, opened anew from its manifest."""
    from ..api import Engine

    mine = _stored(spark, sf_dir)
    mine.delete_many(demo.order_keys(spark, sf_dir).where("o_orderkey % 10 = 3").select("key"))
    mine.compact_tiers(2)
    mine.compact()
    mine.vacuum()
    return Engine(spark, mine.engine.root).collection("orders").live().select(_number())


@query("SELECT o_orderkey, o_orderkey % 7 <> 0 AS found FROM orders")
def compacted_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gets of present and absent keys from a compacted container, whose files can be ruled out by their bloom filters."""
    keys = demo.order_keys(spark, sf_dir)
    mine = _stored(spark, sf_dir)
    mine.delete_many(keys.where("o_orderkey % 7 = 0").select("key"))
    mine.compact()
    return mine.get_many(keys.select("key")).join(keys.select("key", "o_orderkey"), "key").select("o_orderkey", "found")


@query("SELECT r_name AS name, (r_regionkey + 1)::INTEGER AS replication_factor FROM region WHERE r_name <> 'ASIA'")
def discovered_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog that a new engine finds on disk after collections were made and one was dropped."""
    import uuid

    from ..api import Engine
    from ..sources.store import shared_root

    engine = Engine(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}")
    for r in demo.table(spark, sf_dir, "region").collect():  # five requests
        name = r.r_name.replace(" ", "_")
        engine.request({"type": "create_collection", "name": name, "replication_factor": r.r_regionkey + 1})
        assert engine.request({"type": "get_collection", "name": name}) == {"replication_factor": r.r_regionkey + 1}
    engine.request({"type": "drop_collection", "name": "ASIA"})
    return Engine(spark, engine.root).catalog().select(F.replace("name", F.lit("_"), F.lit(" ")).alias("name"), "replication_factor")


_REQUESTS = (
    ({"type": "set", "collection": "t", "key": 1, "value": "x"}, "OK"),
    ({"type": "get", "collection": "t", "key": 1}, "x"),
    ({"type": "get", "collection": "t", "key": 1, "consistency": "two", "timeout": "soon", "replica_index": None}, "x"),
    ({"type": "get", "collection": "t", "key": 1, "consistency": 65535}, "x"),
    ({"type": "get", "collection": "t", "key": 2}, "key_not_found"),
    ({"type": "delete", "collection": "t", "key": 2}, "OK"),
    ({"type": "get", "collection": "none", "key": 1}, "collection_not_found"),
    ({"type": "create_collection", "name": "t"}, "collection_already_exists"),
    ({"type": "get_collection"}, "missing_field"),
    ({"type": "get_collection", "name": 5}, "bad_field_type"),
    ({"type": 7}, "bad_field_type"),
    ({"type": "merge"}, "unsupported_field"),
    ({"type": "get", "collection": "t", "key": 1, "shard": "a-0"}, "key_not_owned_by_shard"),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, '{want}')" for k, (_, want) in enumerate(_REQUESTS)) + ") AS r (number, answer)")
def request_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cluster of three nodes answers to requests, good and bad: errors by their kind, bad optional fields as absent."""
    import uuid

    from .. import errors
    from ..api import Engine
    from ..functions.hashing import murmur3_of
    from ..sources.store import shared_root

    engine = Engine(spark, f"{shared_root(spark)}/store-{uuid.uuid4().hex}", {"a": 1, "b": 1, "c": 1}, 3)
    engine.create_collection("t")
    other = next(s for _, s in reversed(engine.walk(murmur3_of(pack(1)), 3)))
    rows = []
    for k, (fields, _) in enumerate(_REQUESTS):
        try:
            answer = engine.request(fields | ({"shard": other} if "shard" in fields else {}))
        except errors.RequestError as e:
            answer = e.kind
        rows.append((k, str(answer)))
    return spark.createDataFrame(rows, "number int, answer string")


@query(f"WITH {LOG} SELECT {ENTRY}, container_id FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY container_id DESC, ts_nanos DESC, seq DESC) = 1")
def newest_container_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(lww.of_newest_container(demo.events(spark, sf_dir)), "container_id")


@query(f"WITH {LOG} SELECT {ENTRY} FROM log QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(layout.replay(demo.events(spark, sf_dir)))


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lww.newest(demo.table(spark, sf_dir, "conversations"), ("conv_id",), ("turn",)).select("conv_id", "turn", "role", "text")


# --- compaction ----------------------------------------------------------------------------------------------------


@query(f"WITH {LATEST} SELECT {ENTRY}, 1::INTEGER AS container_id FROM latest WHERE NOT is_tombstone")
def compact_drop_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(compaction.compact(demo.events(spark, sf_dir)), "container_id")


@query(f"WITH {LATEST} SELECT {ENTRY}, 1::INTEGER AS container_id FROM latest")
def compact_keep_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(compaction.compact(demo.events(spark, sf_dir), keep_tombstones=True), "container_id")


@query(f"""WITH {LOG}, part AS (SELECT * FROM log WHERE container_id IN (0, 2, 4)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_nanos DESC, seq DESC) = 1)
SELECT {ENTRY}, 5::INTEGER AS container_id FROM part UNION ALL SELECT {ENTRY}, container_id FROM log WHERE container_id NOT IN (0, 2, 4)""")
def compact_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(compaction.compact(demo.events(spark, sf_dir), [0, 2, 4], output=5), "container_id")


#: Containers of very different sizes, of orders by customer.
_UNEVEN = "sizes AS (SELECT (2 * (o_custkey // 100) + CASE WHEN o_orderkey % 7 = 0 THEN 1000 ELSE 0 END)::INTEGER AS container_id, count(*) AS entries FROM orders GROUP BY 1)"


def _uneven(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.floor(F.col("o_custkey") / 100) * 2 + F.when(F.col("o_orderkey") % 7 == 0, 1000).otherwise(0)).cast("int")
    return demo.table(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("collection"), number.alias("container_id")).agg(F.count("*").alias("entries"))


@query(f"WITH {_UNEVEN} SELECT (length(bin(entries)) - 1)::INTEGER AS tier, count(*) AS containers, sum(entries)::BIGINT AS entries FROM sizes GROUP BY 1")
def size_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.size_tiers(_uneven(spark, sf_dir)).select("tier", "containers", "entries")


@query(f"""WITH RECURSIVE {_UNEVEN}, tiers AS (SELECT (length(bin(entries)) - 1)::INTEGER AS tier, sum(entries)::BIGINT AS entries FROM sizes GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY tier) AS i FROM tiers),
fold AS (
  SELECT i, tier, entries AS total, (length(bin(entries)) - 1)::INTEGER AS reach FROM ranked WHERE i = 1
  UNION ALL
  SELECT r.i, r.tier, r.entries + CASE WHEN f.reach > f.tier AND f.reach = r.tier THEN f.total ELSE 0 END,
         (length(bin(r.entries + CASE WHEN f.reach > f.tier AND f.reach = r.tier THEN f.total ELSE 0 END)) - 1)::INTEGER
  FROM fold f JOIN ranked r ON r.i = f.i + 1),
moves AS (SELECT tier, CASE WHEN reach > tier AND reach IN (SELECT tier FROM tiers) THEN reach ELSE tier END AS next_tier FROM fold),
follow AS (
  SELECT tier, tier AS at_tier, 0 AS steps FROM moves
  UNION ALL
  SELECT f.tier, m.next_tier, f.steps + 1 FROM follow f JOIN moves m ON m.tier = f.at_tier WHERE m.next_tier <> f.at_tier),
groups AS (SELECT tier, max(at_tier) AS at_tier FROM follow GROUP BY 1),
placed AS (SELECT g.at_tier AS tier, s.container_id FROM sizes s JOIN groups g ON g.tier = (length(bin(s.entries)) - 1)::INTEGER)
SELECT tier, container_id FROM placed QUALIFY count(*) OVER (PARTITION BY tier) >= 4""")
def compaction_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.candidates(_uneven(spark, sf_dir), 4).select("tier", "container_id")


@query(f"WITH {LOG} SELECT container_id, count(*) AS entries, sum(32 + key_bytes + octet_length(encode(data)))::BIGINT AS bytes FROM log GROUP BY 1")
def container_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.containers(demo.events(spark, sf_dir)).select("container_id", "entries", "bytes")


@query(f"WITH {LOG} SELECT (max(container_id) + 2)::INTEGER AS next_flush, 1::INTEGER AS next_compaction FROM log")
def next_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.next_index(compaction.containers(demo.events(spark, sf_dir))).select("next_flush", "next_compaction")


# --- layout --------------------------------------------------------------------------------------------------------


@query(f"""WITH {LOG}, sized AS (SELECT *, (8 + key_bytes)::BIGINT AS key_size, (32 + key_bytes + octet_length(encode(data)))::BIGINT AS full_size FROM log)
SELECT container_id, seq, key_size, full_size,
  coalesce(sum(full_size) OVER (PARTITION BY container_id ORDER BY key_hex, ts_nanos, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset,
  (16 * (row_number() OVER (PARTITION BY container_id ORDER BY key_hex, ts_nanos, seq) - 1))::BIGINT AS index_offset FROM sized""")
def sstable_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.offsets(demo.events(spark, sf_dir)).select("container_id", "seq", "key_size", "full_size", F.col("offset").alias("byte_offset"), "index_offset")


@query("SELECT (2 * (o_orderkey // 8192))::INTEGER AS container_id, count(*) AS entries, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def flush_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    flushed = layout.flush_unique(demo.orders(spark, sf_dir))
    return flushed.groupBy("container_id").agg(F.count("*").alias("entries"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


@query(f"""WITH RECURSIVE {LOG}, numbered AS MATERIALIZED (
  SELECT node || '-0' AS shard, key_hex, seq, row_number() OVER (PARTITION BY node ORDER BY seq) AS i FROM log),
walk AS (
  SELECT shard, i, seq, key_hex, [key_hex] AS held, 0 AS container_id FROM numbered WHERE i = 1
  UNION ALL
  SELECT n.shard, n.i, n.seq, n.key_hex,
         CASE WHEN list_contains(w.held, n.key_hex) THEN w.held WHEN len(w.held) = 32 THEN [n.key_hex] ELSE list_append(w.held, n.key_hex) END,
         w.container_id + CASE WHEN NOT list_contains(w.held, n.key_hex) AND len(w.held) = 32 THEN 2 ELSE 0 END
  FROM walk w JOIN numbered n ON n.shard = w.shard AND n.i = w.i + 1)
SELECT shard, container_id::INTEGER AS container_id, count(*) AS entries, count(DISTINCT key_hex) AS keys, min(seq) AS first_seq FROM walk GROUP BY 1, 2""")
def flush_by_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = demo.events(spark, sf_dir).withColumn("shard", F.concat("node", F.lit("-0")))
    flushed = layout.flush(log, 32)
    return flushed.groupBy("shard", "container_id").agg(F.count("*").alias("entries"), F.countDistinct("key").alias("keys"), F.min("seq").alias("first_seq"))


@query("""SELECT DISTINCT o_orderkey::VARCHAR || '.data' AS name, o_orderkey::INTEGER AS container_id FROM orders WHERE o_orderkey % 3 = 0""")
def container_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = F.when(F.col("o_orderkey") % 3 == 0, ".data").when(F.col("o_orderkey") % 3 == 1, ".data.tmp").otherwise(".index")
    return layout.container_files(demo.table(spark, sf_dir, "orders").select(F.concat(F.col("o_orderkey").cast("string"), ending).alias("name")), "data")


@query(f"""WITH {LOG}, sized AS (SELECT *, (((32 + key_bytes + octet_length(encode(data))) // 4096 + 1) * 4096)::BIGINT AS wal_bytes FROM log)
SELECT node, seq, wal_bytes, coalesce(sum(wal_bytes) OVER (PARTITION BY node ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wal_offset FROM sized""")
def wal_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.wal_records(demo.events(spark, sf_dir)).select("node", "seq", "wal_bytes", "wal_offset")


# --- ring ----------------------------------------------------------------------------------------------------------


@query(f"WITH {ORDER_KEYS} SELECT o_orderkey, key_hash FROM hashed")
def key_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.order_keys(spark, sf_dir).select("o_orderkey", "key_hash")


@query(f"WITH {string_hash_sql()} SELECT c_name, key_hash FROM named")
def key_hash_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.customer_keys(spark, sf_dir).select("c_name", "key_hash")


@query(f"WITH {ring_sql()} SELECT hash, prev_hash, wraps, node, shard, shard_id FROM ring")
def hash_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.demo_ring(spark)


@query(f"WITH {ORDER_KEYS}, {ring_sql()} SELECT h.o_orderkey, r.node, r.shard FROM hashed h JOIN ring r ON {IN_RING}")
def owner_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.placement(demo.order_keys(spark, sf_dir), demo.demo_ring(spark)).select("o_orderkey", "node", "shard")


@query(f"WITH {ORDER_KEYS}, {ring_sql()}, {replicas_sql()} SELECT h.o_orderkey, r.replica_index, r.node, r.shard FROM hashed h JOIN ring_replicas r ON {IN_RING}")
def replica_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.placement(demo.order_keys(spark, sf_dir), demo.demo_ring(spark), RF).select("o_orderkey", "replica_index", "node", "shard")


@query(f"""WITH {ORDER_KEYS}, {ring_sql()}, {replicas_sql()}, placed AS (SELECT r.* FROM hashed h JOIN ring_replicas r ON {IN_RING})
SELECT ring.node, ring.shard, count(CASE WHEN p.replica_index = 0 THEN 1 END) AS owned, count(p.shard) AS replicas
FROM ring LEFT JOIN placed p ON p.shard = ring.shard GROUP BY 1, 2""")
def shard_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.load(demo.order_keys(spark, sf_dir), demo.demo_ring(spark), RF)


@query(f"WITH {ORDER_KEYS}, {ring_sql()}, {replicas_sql()} SELECT h.o_orderkey FROM hashed h JOIN ring_replicas r ON {IN_RING} WHERE r.replica_index = 1 AND r.shard = 'b-1'")
def owned_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.owned(demo.order_keys(spark, sf_dir), demo.demo_ring(spark), "b-1", 1).select("o_orderkey")


@query(f"""WITH {ring_sql()}, own AS (SELECT hash AS h FROM ring WHERE shard = 'b-1')
SELECT shard, (row_number() OVER (ORDER BY (hash - h + 4294967296) % 4294967296) - 1)::INTEGER AS step FROM ring, own""")
def rotated_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = ring.rotated(demo.demo_ring(spark), "b-1").agg(F.collect_list("shard").alias("s"))  # of the few shards of a ring
    return turned.select(F.posexplode("s").alias("step", "shard")).select("shard", "step")


@query(f"WITH {ORDER_KEYS}, {ring_sql()}, {replicas_sql(3)} SELECT h.o_orderkey, r.shard FROM hashed h JOIN ring_replicas r ON {IN_RING} WHERE r.replica_index = 2")
def last_owning_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.placement(demo.order_keys(spark, sf_dir), demo.demo_ring(spark), 3)
    return placed.groupBy("o_orderkey").agg(F.max_by("shard", "replica_index").alias("shard"))


@query(f"WITH {ring_sql()} SELECT shard, (hash - 4000000000 + 2 * 4294967296) % 4294967296 AS distance FROM ring ORDER BY 2 LIMIT 1")
def closest_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.closest(demo.demo_ring(spark), 4_000_000_000).select("shard", F.pmod(F.col("hash") - 4_000_000_000, F.lit(1 << 32)).alias("distance"))


# --- replication ---------------------------------------------------------------------------------------------------

#: Each event reaches node event_id % 3 and, unless its id is divisible by 5, the next one.
_ANSWERS = f"""{LOG}, copies AS (SELECT *, 0 AS hop FROM log UNION ALL SELECT *, 1 AS hop FROM log WHERE seq % 5 <> 0),
sited AS (SELECT user_id, data, is_tombstone, ts_nanos, seq, ['a', 'b', 'c'][((seq + hop) % 3)::INTEGER + 1] AS node, ((seq + hop) % 3)::INTEGER AS replica_index FROM copies),
answers AS (SELECT * FROM sited QUALIFY row_number() OVER (PARTITION BY user_id, node ORDER BY ts_nanos DESC, seq DESC) = 1)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each node's newest entry of every key."""
    hops = F.when(F.col("seq") % 5 == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    copies = demo.events(spark, sf_dir).withColumn("hop", F.explode(hops)).withColumn("replica_index", ((F.col("seq") + F.col("hop")) % 3).cast("int")).drop("hop")
    sited = copies.withColumn("node", F.element_at(F.array(*map(F.lit, demo.NODES)), F.col("replica_index") + 1))
    return lww.newest(sited, ("collection", "key", "node"))


@query(f"WITH {_ANSWERS} SELECT user_id, data, is_tombstone, ts_nanos, seq, node FROM answers QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_nanos DESC, (node = 'b')::INTEGER DESC, seq DESC, node DESC) = 1")
def replica_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(replication.reconcile(_answers(spark, sf_dir), local="b"), "node")


@query(f"""WITH {_ANSWERS}, first AS (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS answered FROM (SELECT * FROM answers QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY replica_index) <= 2))
SELECT user_id, data, is_tombstone, ts_nanos, seq, answered, answered >= 2 AS acks_met FROM first QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_nanos DESC, seq DESC, replica_index) = 1""")
def quorum_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(replication.read(_answers(spark, sf_dir), replication.Consistency.QUORUM.needed(3)), "answered", "acks_met")


#: As quorum_read, but node c is the coordinator and node a is silent on every third user.
@query(f"""WITH {_ANSWERS}, heard AS (SELECT * FROM answers WHERE NOT (node = 'a' AND user_id % 3 = 0)),
first AS (
  SELECT *, count(*) OVER (PARTITION BY user_id) AS answered
  FROM (SELECT * FROM heard QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (node = 'c')::INTEGER DESC, replica_index) <= 2))
SELECT user_id, data, is_tombstone, ts_nanos, seq, node, answered, answered >= 2 AS acks_met
FROM first QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts_nanos DESC, (node = 'c')::INTEGER DESC, seq DESC, replica_index) = 1""")
def coordinator_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    heard = _answers(spark, sf_dir).where(~((F.col("node") == "a") & (F.col("user_id") % 3 == 0)))
    return shown(replication.read(heard, 2, local="c"), "node", "answered", "acks_met")


@query("""SELECT e.event_id, e.event_type, CASE WHEN e.user_id % 4 < 2 THEN 'ok' WHEN e.event_type IN ('view', 'click') THEN 'collection_not_found'
WHEN e.event_type = 'error' THEN 'ok' ELSE 'none' END AS outcome FROM events e""")
def replica_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type").isin("view", "click"), "set").when(F.col("event_type") == "error", "delete").otherwise("get")
    messages = demo.table(spark, sf_dir, "events").select("event_id", "event_type", kind.alias("kind"), (F.col("user_id") % 4).cast("string").alias("collection"))
    return replication.applied(messages, spark.createDataFrame([("0",), ("1",)], "name string")).select("event_id", "event_type", "outcome")


@query("""SELECT event_id AS seq, (1 + (event_id % 5 <> 0)::INTEGER + (event_id % 7 = 0)::INTEGER)::BIGINT AS acks, 2::INTEGER AS needed,
1 + (event_id % 5 <> 0)::INTEGER + (event_id % 7 = 0)::INTEGER >= 2 AS acks_met FROM events""")
def acks_met(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok = F.array(F.lit(True), F.col("event_id") % 5 != 0, F.col("event_id") % 7 == 0)
    writes = demo.table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.lit(3).alias("replication_factor"), F.explode(ok).alias("ok"))
    return replication.acks(writes, replication.Consistency.QUORUM, ("seq",))


@query(f"""WITH {_ANSWERS}, newest AS (SELECT *, max(ts_nanos) OVER (PARTITION BY user_id) - ts_nanos AS behind_nanos FROM answers)
SELECT user_id, node, seq, behind_nanos::BIGINT AS behind_nanos FROM newest WHERE behind_nanos > 0""")
def stale_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replication.stale(_answers(spark, sf_dir)).select("user_id", "node", "seq", "behind_nanos")


# --- migration and control -----------------------------------------------------------------------------------------


def _moves_sql(before: str, after: str) -> str:
    return f"""WITH {ORDER_KEYS}, {ring_sql(before, "was")}, {replicas_sql(RF, "was")}, {ring_sql(after, "now")}, {replicas_sql(RF, "now")},
p_was AS MATERIALIZED (SELECT h.o_orderkey, r.replica_index, r.shard FROM hashed h JOIN was_replicas r ON {IN_RING}),
p_now AS MATERIALIZED (SELECT h.o_orderkey, r.replica_index, r.shard FROM hashed h JOIN now_replicas r ON {IN_RING}),
sources AS (SELECT o_orderkey, shard FROM p_was WHERE shard IN (SELECT shard FROM now) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY replica_index) = 1)
SELECT n.o_orderkey, CASE WHEN s.shard IS NULL THEN 'lost' ELSE 'send' END AS action, s.shard AS from_shard, n.shard AS to_shard
FROM p_now n LEFT JOIN p_was w ON w.o_orderkey = n.o_orderkey AND w.shard = n.shard LEFT JOIN sources s ON s.o_orderkey = n.o_orderkey WHERE w.shard IS NULL
UNION ALL
SELECT w.o_orderkey, 'delete', w.shard, NULL FROM p_was w LEFT JOIN p_now n ON n.o_orderkey = w.o_orderkey AND n.shard = w.shard
WHERE n.shard IS NULL AND w.shard IN (SELECT shard FROM now)"""


def _moves(spark: SparkSession, sf_dir: str, before: str, after: str) -> DataFrame:
    keys = demo.order_keys(spark, sf_dir).select("o_orderkey", "key_hash")
    return migration.plan(keys, demo.demo_ring(spark, tuple(before)), demo.demo_ring(spark, tuple(after)), RF).drop("key_hash")


@query(_moves_sql("abc", "ab"))
def migrate_on_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir, "abc", "ab")


@query(_moves_sql("bc", "abc"))
def migrate_on_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moves(spark, sf_dir, "bc", "abc")


_NOW = 1_700_000_000_000_000_000


@query(f"""{_moves_sql("bc", "abc").split("SELECT n.o_orderkey, CASE")[0].rstrip()},
stored AS (SELECT o_orderkey, shard FROM p_was WHERE shard IN (SELECT shard FROM now))
SELECT o_orderkey, shard, false AS is_tombstone FROM stored
UNION ALL
SELECT n.o_orderkey, n.shard, false FROM p_now n LEFT JOIN p_was w ON w.o_orderkey = n.o_orderkey AND w.shard = n.shard JOIN sources s ON s.o_orderkey = n.o_orderkey WHERE w.shard IS NULL
UNION ALL
SELECT w.o_orderkey, w.shard, true FROM stored w LEFT JOIN p_now n ON n.o_orderkey = w.o_orderkey AND n.shard = w.shard WHERE n.shard IS NULL""")
def migrate_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shard's entries after a node has joined: sent entries as they were, deleted ones under a tombstone of now."""
    keys = demo.order_keys(spark, sf_dir)
    was, now = demo.demo_ring(spark, ("b", "c")), demo.demo_ring(spark)
    moves = migration.plan(keys.select("collection", "key", "o_orderkey", "key_hash"), was, now, RF)
    stored = ring.placement(keys, was, RF).drop("node", "replica_index").withColumns({"data": F.encode(F.lit("x"), "UTF-8"), "is_tombstone": F.lit(False), "ts_nanos": F.lit(1).cast("long")})
    return migration.apply(stored, moves, _NOW, "tombstone").select("o_orderkey", "shard", "is_tombstone")


_GOSSIP = """gossip AS (SELECT 'n' || (event_id % 50) AS source, CASE event_type WHEN 'view' THEN 'CreateCollection' WHEN 'error' THEN 'DropCollection' WHEN 'click' THEN 'Alive' ELSE 'Dead' END AS kind,
'p' || (user_id % 40) AS payload, (epoch_us(ts) * 1000)::BIGINT AS ts_nanos FROM events)"""


def _gossip(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "CreateCollection").when(F.col("event_type") == "error", "DropCollection").when(F.col("event_type") == "click", "Alive").otherwise("Dead")
    from ..sources.oplog import nanos

    return demo.table(spark, sf_dir, "events").select(F.concat(F.lit("n"), (F.col("event_id") % 50).cast("string")).alias("source"), kind.alias("kind"), F.concat(F.lit("p"), (F.col("user_id") % 40).cast("string")).alias("payload"), nanos(F.col("ts")).alias("ts_nanos"))


@query(f"""WITH {_GOSSIP}, seen AS (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY ts_nanos, payload)::INTEGER AS seen FROM gossip)
SELECT source, kind, payload, ts_nanos, seen, seen = 1 AS handled, seen <= 3 AS forwarded FROM seen""")
def gossip_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.gossip_counts(_gossip(spark, sf_dir))


_EXPIRE = 30_000_000_000


@query(f"""WITH RECURSIVE {_GOSSIP}, numbered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source, kind ORDER BY ts_nanos, payload) AS i FROM gossip),
fold AS (
  SELECT source, kind, payload, ts_nanos, i, 1 AS n, 1 AS seen, NULL::BIGINT AS timer FROM numbered WHERE i = 1
  UNION ALL
  SELECT x.source, x.kind, x.payload, x.ts_nanos, x.i,
         CASE WHEN x.ts_nanos >= f.timer + {_EXPIRE} THEN 1 WHEN f.n < 3 THEN f.n + 1 ELSE f.n END,
         CASE WHEN x.ts_nanos >= f.timer + {_EXPIRE} THEN 1 WHEN f.n < 3 THEN f.n + 1 ELSE 4 END,
         CASE WHEN x.ts_nanos >= f.timer + {_EXPIRE} THEN NULL WHEN f.timer IS NULL AND f.n >= 3 THEN x.ts_nanos ELSE f.timer END
  FROM fold f JOIN numbered x ON x.source = f.source AND x.kind = f.kind AND x.i = f.i + 1)
SELECT source, kind, payload, ts_nanos, seen::INTEGER AS seen, seen = 1 AS handled, seen <= 3 AS forwarded FROM fold""")
def gossip_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.gossip_with_expiry(_gossip(spark, sf_dir))


@query(f"WITH {_GOSSIP} SELECT payload AS source, 'Alive' AS kind, payload, ts_nanos FROM gossip WHERE kind = 'Dead' AND payload IN ('p1', 'p2', 'p3')")
def self_announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.self_announcements(_gossip(spark, sf_dir), spark.createDataFrame([("p1",), ("p2",), ("p3",)], "node string"))


@query("""SELECT source, node FROM (SELECT a.n_name AS source, b.n_name AS node FROM nation a, nation b WHERE a.n_name <> b.n_name)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY md5('7:' || source || ':' || node), node) <= 3""")
def gossip_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = demo.table(spark, sf_dir, "nation").select(F.col("n_name").alias("node"))
    return control.fanout(nodes, nodes, 3, 7)


@query(f"WITH {_GOSSIP} SELECT payload AS name FROM gossip WHERE kind IN ('CreateCollection', 'DropCollection') QUALIFY row_number() OVER (PARTITION BY payload ORDER BY ts_nanos DESC, kind DESC) = 1 AND kind = 'CreateCollection'")
def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.collections(control.distinct_events(_gossip(spark, sf_dir)).unionByName(_gossip(spark, sf_dir)))


@query(f"WITH {_GOSSIP} SELECT payload AS node FROM gossip WHERE kind IN ('Alive', 'Dead') QUALIFY row_number() OVER (PARTITION BY payload ORDER BY ts_nanos DESC, kind DESC) = 1 AND kind = 'Alive'")
def nodes_alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return control.nodes_alive(_gossip(spark, sf_dir))


@query("""SELECT 3::BIGINT AS n_nodes, 'a,b,c' AS node_names, count(*) AS n_collections, sum(r_regionkey % 3 + 1)::BIGINT AS factors FROM region""")
def cluster_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = demo.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") % 3 + 1).cast("int").alias("replication_factor"))
    made = control.cluster_metadata(demo.nodes(spark), catalog)
    total = F.aggregate(F.map_values("collections"), F.lit(0).cast("long"), lambda a, x: a + x)
    return made.select(F.size("nodes").cast("long").alias("n_nodes"), F.array_join(F.col("nodes.node"), ",").alias("node_names"), F.size("collections").cast("long").alias("n_collections"), total.alias("factors"))


@query("""SELECT n.n_name AS name, (n.n_nationkey % 3 + 1)::INTEGER AS replication_factor, r.r_name IS NULL AS created
FROM nation n LEFT JOIN region r ON r.r_name = n.n_name""")
def create_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = demo.table(spark, sf_dir, "region").select(F.col("r_name").alias("name"))
    return control.create(catalog, demo.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), (F.col("n_nationkey") % 3 + 1).cast("int").alias("replication_factor")))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey <> 1")
def drop_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = demo.table(spark, sf_dir, "nation").withColumnRenamed("n_name", "name")
    return control.drop(nation, nation.where("n_regionkey = 1")).select("name")


# --- statistics and streams ----------------------------------------------------------------------------------------

_AT = {"p50": "5 // 10", "p90": "9 // 10", "p99": "99 // 100", "p999": "999 // 1000"}


@query("SELECT event_type AS op, count(*) AS n, round(sum(value), 4) AS total, min(value) AS min, max(value) AS max, "
       + ", ".join(f"list_sort(list(value))[((count(*) - 1) * {p}) + 1] AS {k}" for k, p in _AT.items()) + " FROM events GROUP BY 1")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.latency(demo.table(spark, sf_dir, "events").withColumnRenamed("event_type", "op"), "value")
    return out.withColumn("total", F.round("total", 4))


@query(f"WITH {LATEST} SELECT {ENTRY} FROM latest WHERE NOT is_tombstone")
def stream_live_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live view of a collection that a file stream of the events filled."""
    import uuid

    from ..api import Engine
    from ..functions.msgpack import encode_int
    from ..sources.oplog import nanos
    from ..sources.store import shared_root
    from ..streaming.upsert import upsert

    top = f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"
    schema = demo.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    data = F.encode(F.concat_ws(":", "event_type", F.coalesce("props", F.lit(""))), "UTF-8")
    rows = stream.select(encode_int(F.col("user_id")).alias("key"), data.alias("data"), (F.col("event_type") == "error").alias("is_tombstone"), nanos(F.col("ts")).alias("ts_nanos"), F.col("event_id").alias("seq"))
    collection = Engine(spark, f"{top}/store").create_collection("events")
    upsert(rows, collection, f"{top}/checkpoint").awaitTermination()
    users = demo.table(spark, sf_dir, "events").select("user_id").distinct().withColumn("key", encode_int(F.col("user_id")))
    return shown(collection.live().join(users, "key"))
