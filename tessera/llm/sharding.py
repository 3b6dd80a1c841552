"""Sharding by fixed virtual slots.

Records hash into VIRTUAL_SLOTS slots, a number that never changes. Bytes and
rows are aggregated per slot, and a slot map (one shard number per slot, with a
version) says which shard holds a slot. Rebalancing edits the map: moving a slot
moves only its records. The law held is `bytes`: sizes of shards near equal.

Records of equal texts are a group and hash by their text, so that a group lies
in one slot and thus in one shard. Only a group of more than 1 / GROUP_SHARE of
a shard's bytes is dealt over the slots row by row: kept whole it would tilt the
shards, and its rows would meet in one task. There are at most shards x
GROUP_SHARE such groups. The place of a record in its shard is the number of
rows in the shard's earlier slots plus its place in its own slot, so that
numbering works on thousands of small groups.

Nulls and edge cases: a null text has size 1 and checksum 0 and is a group of
its own, apart from the empty text; a null id is a value like others; equal rows
of a group that is dealt may change places from run to run; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import dataclasses
import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm._common import documents, shared_dir, staged

VIRTUAL_SLOTS = 4096
SHARDS = 16
GROUP_SHARE = 16


@dataclasses.dataclass(frozen=True)
class SlotMap:
    """Shard of each virtual slot, and the version of this assignment."""

    shard_of: tuple[int, ...]
    n_shards: int
    version: int = 1

    @staticmethod
    def build(slot_bytes: list[int], n_shards: int) -> SlotMap:
        """Largest slots first, each to the shard with the least bytes so far."""
        shard_of, loads = [0] * len(slot_bytes), [(0, 0, k) for k in range(n_shards)]
        for slot in sorted(range(len(slot_bytes)), key=lambda s: (-slot_bytes[s], s)):
            load, n, k = heapq.heappop(loads)
            shard_of[slot] = k
            heapq.heappush(loads, (load + slot_bytes[slot], n + 1, k))
        return SlotMap(tuple(shard_of), n_shards)

    def loads(self, slot_bytes: list[int]) -> list[int]:
        out = [0] * self.n_shards
        for slot, k in enumerate(self.shard_of):
            out[k] += slot_bytes[slot]
        return out

    def rebalance(self, slot_bytes: list[int], n_shards: int | None = None, tolerance: float = 0.01) -> SlotMap:
        """A next version with few slots moved: from the fullest shard to the emptiest while that narrows the gap and it is over tolerance.

        With a larger n_shards, slots move to new shards only, until each has its share.
        """
        n = n_shards or self.n_shards
        shard_of, loads = list(self.shard_of), [*self.loads(slot_bytes), *[0] * (n - self.n_shards)]
        held: list[list[int]] = [[] for _ in range(n)]
        for slot, k in enumerate(shard_of):
            held[k].append(slot)
        mean = sum(loads) / n
        open_to = range(self.n_shards, n) if n > self.n_shards else range(n)
        for _ in range(4 * len(shard_of)):
            a, b = max(range(n), key=loads.__getitem__), min(open_to, key=loads.__getitem__)
            gap = loads[a] - loads[b]
            movable = [s for s in held[a] if 0 < slot_bytes[s] < gap]
            if not movable or gap <= tolerance * mean or (n > self.n_shards and (a >= self.n_shards or loads[b] >= mean)):
                break
            s = min(movable, key=lambda s: (abs(gap / 2 - slot_bytes[s]), s))
            held[a].remove(s)
            held[b].append(s)
            shard_of[s] = b
            loads[a] -= slot_bytes[s]
            loads[b] += slot_bytes[s]
        return SlotMap(tuple(shard_of), n, self.version + 1)

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.version, self.n_shards, s, k) for s, k in enumerate(self.shard_of)], "version int, n_shards int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Append this version to the map's table."""
        self.to_df(spark).coalesce(1).write.mode("append").partitionBy("version").parquet(path)

    @staticmethod
    def exists(spark: SparkSession, path: str) -> bool:
        context = spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(context._jsc.hadoopConfiguration()).exists(p)

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        d = spark.read.parquet(path)
        version = d.agg(F.max("version")).first()[0] if version is None else version
        rows = sorted(d.filter(F.col("version") == version).select("vslot", "shard", "n_shards").collect())
        return SlotMap(tuple(r.shard for r in rows), rows[0].n_shards, version)


def virtual_slot(*keys: Column, n_slots: int = VIRTUAL_SLOTS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_totals(records: DataFrame, n_slots: int = VIRTUAL_SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot; n_slots numbers, whatever the input."""
    size, rows = [0] * n_slots, [0] * n_slots
    for r in records.groupBy("vslot").agg(F.sum("size").alias("b"), F.count(F.lit(1)).alias("n")).collect():
        size[r.vslot], rows[r.vslot] = r.b, r.n
    return size, rows


def assign(records: DataFrame, slot_map: SlotMap, slot_rows: list[int], order: list[str]) -> DataFrame:
    """Add shard and slot, the record's place in its shard (gapless from 0)."""
    spark = records.sparkSession
    start, table = [0] * slot_map.n_shards, []
    for s, k in enumerate(slot_map.shard_of):
        table.append((s, k, start[k]))
        start[k] += slot_rows[s]
    places = spark.createDataFrame(table, "vslot int, shard int, first long")
    numbered = records.withColumn("at", F.row_number().over(Window.partitionBy("vslot").orderBy(*order)) - 1)
    return numbered.join(F.broadcast(places), "vslot").withColumn("slot", F.col("first") + F.col("at")).drop("first", "at")


def large_groups(records: DataFrame, n_shards: int, group_share: int = GROUP_SHARE) -> list[int]:
    """Hashes of texts whose rows have more than 1 / group_share of a shard's bytes: n_shards * group_share of them at most."""
    total = records.agg(F.sum("size")).first()[0] or 0
    bytes_ = records.groupBy("text_hash").agg(F.sum("size").alias("b")).filter(F.col("b") * n_shards * group_share > F.lit(total))
    return [r.text_hash for r in bytes_.collect()]


def shard(df: DataFrame, n_shards: int = SHARDS, id_col: str = "doc_id", text: str = "text", slot_map: SlotMap | None = None, map_path: str | None = None, group_share: int = GROUP_SHARE) -> DataFrame:
    """One row per row of df: id, size, text_crc32, law, shard, slot, vslot.

    A given map is used as it is. With map_path the latest stored version is edited for these records, or a first one is
    built, and the version used is stored there. Else a map is built and forgotten.
    """
    spark = df.sparkSession
    checksum = F.coalesce(F.crc32(text), F.lit(0)).cast("long")
    records = df.select(F.col(id_col), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), checksum.alias("text_crc32"), F.xxhash64(F.col(text)).alias("text_hash"))
    records = staged(records, "records")
    large = spark.createDataFrame([(h,) for h in large_groups(records, n_shards, group_share)], "text_hash long").withColumn("dealt", F.lit(True))
    records = records.join(F.broadcast(large), "text_hash", "left")
    place = F.when(F.col("dealt"), F.xxhash64("text_hash", F.col(id_col), F.monotonically_increasing_id())).otherwise(F.col("text_hash"))
    records = staged(records.select(id_col, "size", "text_crc32", virtual_slot(place).alias("vslot")), "slots")
    slot_bytes, slot_rows = slot_totals(records)
    if slot_map is None and map_path is not None and SlotMap.exists(spark, map_path):
        old = SlotMap.load(spark, map_path)
        slot_map = old.rebalance(slot_bytes, n_shards)
        slot_map = old if slot_map.shard_of == old.shard_of else slot_map
    slot_map = slot_map or SlotMap.build(slot_bytes, n_shards)
    if map_path is not None and not (SlotMap.exists(spark, map_path) and SlotMap.load(spark, map_path) == slot_map):
        slot_map.save(spark, map_path)
    return assign(records, slot_map, slot_rows, [id_col, "text_crc32", "size"]).withColumn("law", F.lit("bytes"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16, by bytes. The map's first version is stored in the shared folder and read again from there."""
    path = f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}/slot-map-{uuid.uuid4().hex[:12]}"
    out = shard(documents(spark, sf_dir), map_path=path)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot")
