"""The engine: collections of keyed documents over a shared folder."""

from __future__ import annotations

import bisect
import json
import re
import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import errors
from .functions.hashing import murmur3, murmur3_of
from .functions.msgpack import pack, unpack
from .operators import compaction, control, lww, migration, replication, ring, scan
from .operators.replication import Consistency
from .sources.oplog import SCHEMA, checked
from .sources.store import BLOOM_MIN_BYTES, Files, Store

_NAME = re.compile(r"[A-Za-z0-9_.-]+")
MAX_U16, MAX_U32 = (1 << 16) - 1, (1 << 32) - 1


class Engine:
    """``nodes``: the cluster as {name: number of shards}; it decides placement, not where Spark runs.  ``down``: the nodes
    that don't answer: writes miss them, and reads and clients pass them over."""

    def __init__(self, spark: SparkSession, root_dir: str, nodes: dict[str, int] | None = None, default_replication_factor: int = 1, down: tuple[str, ...] = ()):
        self.spark, self.root, self.default_replication_factor = spark, root_dir.rstrip("/"), default_replication_factor
        self.node_list, self.down = dict(nodes or {"a": 1}), set(down)
        self.files = Files(spark, self.root)

    # --- collections
    def _metadata(self, name: str) -> str:
        if not isinstance(name, str):
            raise errors.BadFieldType("name")
        if not _NAME.fullmatch(name):
            raise errors.BadFieldType(f"name {name!r}")
        return f"{self.root}/{name}.metadata"

    def create_collection(self, name: str, replication_factor: int | None = None) -> Collection:
        factor = self.default_replication_factor if replication_factor is None else replication_factor
        if not isinstance(factor, int) or not 1 <= factor < MAX_U16:
            raise errors.BadFieldType("replication_factor")
        if not self.files.create(self._metadata(name), json.dumps({"replication_factor": factor})):
            raise errors.CollectionAlreadyExists(name)
        return Collection(self, name, factor)

    def collection(self, name: str) -> Collection:
        path = self._metadata(name)
        if f"{name}.metadata" not in self.files.names(self.root):
            raise errors.CollectionNotFound(name)
        return Collection(self, name, json.loads(self.files.read(path))["replication_factor"])

    def drop_collection(self, name: str) -> None:
        self.collection(name)
        self.files.delete(self._metadata(name))
        self.files.delete(f"{self.root}/{name}")

    def catalog(self) -> DataFrame:
        """name, replication_factor."""
        names = [n.removesuffix(".metadata") for n in self.files.names(self.root) if n.endswith(".metadata")]
        rows = [(n, self.collection(n).replication_factor) for n in names]
        return self.spark.createDataFrame(rows, "name string, replication_factor int")

    # --- cluster
    def nodes(self) -> DataFrame:
        return self.spark.createDataFrame([(n, list(range(k))) for n, k in self.node_list.items()], "node string, ids array<int>")

    def ring(self) -> DataFrame:
        return ring.ring(self.nodes())

    def walk(self, key_hash: int, replication_factor: int) -> list[tuple[str, str]]:
        """Node and shard of a hash's replicas, the owner first: what :meth:`placement` gives, for one key on the driver."""
        shards = sorted((murmur3_of(f"{n}-{i}".encode()), f"{n}-{i}", n) for n, k in self.node_list.items() for i in range(k))
        at = bisect.bisect_left(shards, (key_hash,))
        found: dict[str, str] = {}
        for k in range(len(shards)):
            _, shard, node = shards[(at + k) % len(shards)]
            if len(found) < replication_factor:
                found.setdefault(node, shard)
        return list(found.items())

    def route(self, name: str) -> str:
        """The shard that a client asks for a collection's metadata: the owner of its name's hash."""
        return self.walk(murmur3_of(pack(name)), 1)[0][1]

    def apply(self, kind: str, collection: str, key, value=None, ts_nanos: int | None = None, node: str | None = None):
        """A message from another replica, with its timestamp, for one node's copy.  Of a collection that isn't known here, a set
        fails, a delete is fine and a get gives None."""
        try:
            mine = self.collection(collection)
        except errors.CollectionNotFound:
            if kind == "set":
                raise
            return None
        if kind == "get":
            raw = pack(key)
            log = mine.raw_log().where(F.col("key_hash") == murmur3_of(raw))
            row = lww.latest(scan.key_exactly(log, raw).where(F.col("node").isNull() | (F.col("node") == node) if node else F.lit(True))).first()
            return None if row is None else {"data": bytes(row.data), "is_tombstone": row.is_tombstone, "ts_nanos": row.ts_nanos}
        if kind not in ("set", "delete"):
            raise errors.UnsupportedField(kind)
        mine.append(mine.rows_of(key, None if kind == "delete" else value, [node], ts_nanos))
        return None

    def cluster_metadata(self) -> DataFrame:
        return control.cluster_metadata(self.nodes(), self.catalog())

    def placement(self, keys: DataFrame, replication_factor: int | None = None) -> DataFrame:
        """``keys`` (key) with key_hash and the replicas."""
        hashed = keys if "key_hash" in keys.columns else keys.withColumn("key_hash", murmur3(F.col("key")))
        return ring.placement(hashed, self.ring(), replication_factor or self.default_replication_factor)

    def migration_plan(self, keys: DataFrame, nodes_after: dict[str, int], replication_factor: int | None = None) -> DataFrame:
        after = Engine(self.spark, self.root, nodes_after)
        hashed = keys if "key_hash" in keys.columns else keys.withColumn("key_hash", murmur3(F.col("key")))
        return migration.plan(hashed, self.ring(), after.ring(), replication_factor or self.default_replication_factor)

    # --- requests as a client sends them
    def request(self, fields):
        """Answers one request (a dict with type and its fields); raises :mod:`tidelog.errors`."""
        if not isinstance(fields, dict):
            raise errors.BadFieldType("document")
        kind = fields.get("type")
        if kind is None:
            raise errors.MissingField("type")
        if not isinstance(kind, str):
            raise errors.BadFieldType("type")
        if kind == "get_cluster_metadata":
            return self.cluster_metadata().first().asDict(True)
        if kind == "create_collection":
            factor = _number(fields, "replication_factor", MAX_U16)
            self.create_collection(_field(fields, "name", str), factor)
            return "OK"
        if kind == "get_collection":
            return {"replication_factor": self.collection(_field(fields, "name", str)).replication_factor}
        if kind == "drop_collection":
            self.drop_collection(_field(fields, "name", str))
            return "OK"
        if kind not in ("set", "delete", "get"):
            raise errors.UnsupportedField(kind)
        mine = self.collection(_field(fields, "collection", str))
        key = _field(fields, "key")
        self._owned(key, fields)
        consistency = _number(fields, "consistency", MAX_U16)
        if consistency == 0:
            raise errors.BadFieldType("consistency")
        asked = Consistency.fixed(consistency or 1)
        index = _number(fields, "replica_index", MAX_U16) or 0
        if kind == "get":
            return mine.get_value(key, asked, index)
        if kind == "set":
            mine.set(key, _field(fields, "value"), asked, index)
        else:
            mine.delete(key, asked, index)
        return "OK"

    def _owned(self, key, fields: dict) -> None:
        """If a request names the shard it went to, the key's replica of replica_index must be that shard."""
        if "shard" not in fields:
            return
        h = _number(fields, "hash", MAX_U32)
        h = murmur3_of(pack(key)) if h is None else h
        keys = self.spark.createDataFrame([(h,)], "key_hash bigint")
        if ring.owned(keys, self.ring(), fields["shard"], _number(fields, "replica_index", MAX_U16) or 0).isEmpty():
            raise errors.KeyNotOwnedByShard(fields["shard"])


def _field(fields: dict, name: str, kind: type | None = None):
    value = fields.get(name)
    if value is None:
        raise errors.MissingField(name)
    if kind is not None and not isinstance(value, kind):
        raise errors.BadFieldType(name)
    return value


def _number(fields: dict, name: str, most: int) -> int | None:
    """An optional whole number below ``most``; one of another type or size counts as absent."""
    value = fields.get(name)
    return value if isinstance(value, int) and not isinstance(value, bool) and 0 <= value < most else None


class Collection:
    def __init__(self, engine: Engine, name: str, replication_factor: int):
        self.engine, self.name, self.replication_factor = engine, name, replication_factor
        self.spark, self.store = engine.spark, Store(engine.spark, f"{engine.root}/{name}")

    # --- writes
    def append(self, log: DataFrame, batch: tuple[str, int] | None = None) -> None:
        """Adds op-log rows (key, data, is_tombstone; ts_nanos and seq if there) as a container.

        ``batch``: a stream's name and batch number; a batch that has been added is not added again."""
        was = self.store.manifest()
        if batch is not None and was["batches"].get(batch[0], -1) >= batch[1]:
            return
        first = max([c["max_seq"] for c in was["containers"]], default=-1) + 1
        given = set(log.columns)
        rows = log.withColumns({
            "collection": F.lit(self.name), "key_hash": murmur3(F.col("key")),
            "ts_nanos": F.col("ts_nanos").cast("long") if "ts_nanos" in given else F.lit(time.time_ns()),
            "seq": (F.col("seq").cast("long") if "seq" in given else F.monotonically_increasing_id()) + (0 if "seq" in given else first),
            "is_tombstone": F.coalesce("is_tombstone", F.lit(False)) if "is_tombstone" in given else F.lit(False),
            "node": F.col("node") if "node" in given else F.lit(None).cast("string"), "shard": F.col("shard") if "shard" in given else F.lit(None).cast("string"),
        })
        rows = rows.withColumn("data", F.when(F.col("is_tombstone"), F.unhex(F.lit(""))).otherwise(F.col("data")))
        even = [c["id"] for c in was["containers"] if c["id"] % 2 == 0]
        made = self.store.write(checked(rows), max(even, default=was["batches"].get("_flushed", -2)) + 2)
        batches = was["batches"] | ({batch[0]: batch[1]} if batch else {}) | ({"_flushed": made["id"]} if made else {})
        if made or batch:
            self.store.commit(was, was["containers"] + ([made] if made else []), batches)

    def set_many(self, rows: DataFrame) -> None:
        """Sets rows of key and data (both MessagePack bytes; ts_nanos and seq if there)."""
        self.append(rows.drop("is_tombstone"))

    def delete_many(self, keys: DataFrame) -> None:
        """Deletes keys, absent ones too."""
        self.append(keys.withColumns({"data": F.unhex(F.lit("")), "is_tombstone": F.lit(True)}))

    def rows_of(self, key, value, nodes: list[str | None], ts_nanos: int | None = None) -> DataFrame:
        """Op-log rows that set a key (value None: delete it) on each of the nodes (None: on all replicas)."""
        now = time.time_ns() if ts_nanos is None else ts_nanos
        data = bytearray(b"" if value is None else pack(value))
        rows = [(bytearray(pack(key)), data, value is None, now, n) for n in nodes]
        return self.spark.createDataFrame(rows, "key binary, data binary, is_tombstone boolean, ts_nanos long, node string")

    def answering(self, key, replica_index: int = 0) -> list[str]:
        """Nodes of the key's replicas that answer, from the coordinator on: the replica of that index, or the next that lives."""
        walk = [n for n, _ in self.engine.walk(murmur3_of(pack(key)), self.replication_factor)]
        return [n for n in walk[replica_index:] if n not in self.engine.down]

    def _write(self, key, value, consistency: Consistency, replica_index: int) -> dict:
        """The coordinator writes and sends on to the later replicas; those that don't answer miss the write."""
        needed = consistency.needed(self.replication_factor)
        alive = self.answering(key, replica_index)
        if not alive:
            raise errors.Timeout("no replica answers")
        whole = not self.engine.down and not replica_index
        self.append(self.rows_of(key, value, [None] if whole else alive))
        return {"acks": len(alive), "needed": needed, "acks_met": len(alive) >= needed}

    def set(self, key, value, consistency: Consistency = Consistency.fixed(1), replica_index: int = 0) -> dict:
        """Sets a key on its replicas; gives acks, needed and acks_met."""
        if key is None or value is None:
            raise errors.MissingField("key" if key is None else "value")
        return self._write(key, value, consistency, replica_index)

    def delete(self, key, consistency: Consistency = Consistency.fixed(1), replica_index: int = 0) -> dict:
        """Deletes a key, an absent one too; gives acks, needed and acks_met."""
        if key is None:
            raise errors.MissingField("key")
        return self._write(key, None, consistency, replica_index)

    # --- reads
    def raw_log(self) -> DataFrame:
        return self.store.read()

    def entries(self) -> DataFrame:
        """The newest entry of each key, tombstones included."""
        return lww.latest(self.raw_log())

    def live(self) -> DataFrame:
        return lww.live(self.raw_log())

    def get(self, key, consistency: Consistency = Consistency.fixed(1), replica_index: int = 0) -> DataFrame:
        """The live entry of a key (any value that MessagePack holds), or no row.

        With several replicas, the newest of the answers of the coordinator and of the next ones, as many as ``consistency``
        needs; a replica's answer is the newest entry that it was sent."""
        needed = consistency.needed(self.replication_factor)
        raw = pack(key)
        log = scan.key_exactly(self.raw_log().where(F.col("key_hash") == murmur3_of(raw)), raw)
        if self.replication_factor == 1:
            return scan.point(log, raw)
        alive = self.answering(key, replica_index)
        if not alive:
            raise errors.Timeout("no replica answers")
        replica = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(k).alias("replica_index")) for k, n in enumerate(alive[:needed])]))
        copies = log.withColumn("_r", replica).where(F.col("node").isNull() | (F.col("node") == F.col("_r.node")))
        copies = copies.withColumns({"node": F.col("_r.node"), "replica_index": F.col("_r.replica_index")}).drop("_r")
        answers = lww.newest(copies, ("collection", "key", "node"))
        best = replication.read(answers, needed, local=alive[0])
        return best.select(*SCHEMA.names).where(~F.col("is_tombstone"))

    def get_value(self, key, consistency: Consistency = Consistency.fixed(1), replica_index: int = 0):
        row = self.get(key, consistency, replica_index).first()
        if row is None:
            raise errors.KeyNotFound(repr(key))
        return unpack(bytes(row.data))

    def get_many(self, keys: DataFrame) -> DataFrame:
        """collection, key, data, found of the asked keys (key)."""
        return scan.many(self.raw_log(), keys.select(F.lit(self.name).alias("collection"), "key"))

    def scan(self, key_range: tuple[bytes | None, bytes | None] | None = None, hash_range: tuple[int, int] | None = None, where: Column | None = None) -> DataFrame:
        """Raw entries in a range of keys [start, end), of hashes (start, end], and by predicate."""
        out = self.raw_log()
        if key_range is not None:
            out = scan.key_range(out, *key_range)
        if hash_range is not None:
            out = scan.hash_range(out, *hash_range)
        return scan.filtered(out, where) if where is not None else out

    def replicated(self) -> DataFrame:
        """The raw log with replica_index, node and shard: a row for each replica that holds the entry."""
        return ring.placement(self.raw_log().drop("node", "shard"), self.engine.ring(), self.replication_factor)

    # --- compaction
    def compaction_plan(self, factor: int = 2) -> DataFrame:
        return compaction.candidates(self.store.sizes(collection=self.name), factor)

    def compact(self, containers: list[int] | None = None, keep_tombstones: bool | None = None) -> dict:
        """Merges containers (all by default) and gives the new manifest; old folders stay for readers of old versions."""
        was = self.store.manifest()
        every = {c["id"] for c in was["containers"]}
        chosen = every if containers is None else set(containers)
        if not chosen <= every:
            raise errors.RequestError(f"no containers {sorted(chosen - every)}")
        if not chosen:
            return was
        keep = chosen != every if keep_tombstones is None else keep_tombstones
        odd = [c["id"] for c in was["containers"] if c["id"] % 2]
        merged = compaction.by_replica(self.store.read(was, chosen), keep)
        size = sum(c["bytes"] for c in was["containers"] if c["id"] in chosen)
        made = self.store.write(merged, max([*odd, was["batches"].get("_compacted", -1)]) + 2, bloom=size > BLOOM_MIN_BYTES)
        rest = [c for c in was["containers"] if c["id"] not in chosen]
        # a compacted container keeps the highest seq of its inputs, so later arrivals stay later
        top = max(c["max_seq"] for c in was["containers"] if c["id"] in chosen)
        batches = was["batches"] | ({"_compacted": made["id"]} if made else {})
        return self.store.commit(was, rest + ([made | {"max_seq": top}] if made else []), batches)

    def compact_tiers(self, factor: int = 2) -> dict:
        """Merges the groups of containers of about a size that :meth:`compaction_plan` names, smallest first; tombstones go only
        where a group is all that there is."""
        groups: dict[int, list[int]] = {}
        for r in self.compaction_plan(factor).collect():  # a row a container
            groups.setdefault(r.tier, []).append(r.container_id)
        for tier in sorted(groups):
            self.compact(groups[tier])
        return self.store.manifest()

    def vacuum(self, keep_versions: int = 1) -> None:
        """Deletes old manifests and the folders that only they name."""
        names = [n for n in self.store.files.names(self.store.path) if n.startswith("manifest-") and n.endswith(".json")]
        used: set[str] = set()
        for n in names[-keep_versions:]:
            used |= {c["folder"] for c in json.loads(self.store.files.read(f"{self.store.path}/{n}"))["containers"]}
        for n in names[:-keep_versions]:
            self.store.files.delete(f"{self.store.path}/{n}")
        for n in self.store.files.names(self.store.path):
            if n.startswith("container-") and n not in used:
                self.store.files.delete(f"{self.store.path}/{n}")


__all__ = ["SCHEMA", "Collection", "Consistency", "Engine", "replication"]
