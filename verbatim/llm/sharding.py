"""Sharding over fixed virtual slots with a versioned slot-to-shard map.

A record's slot depends on its key alone; shards own slots. A slot that holds much
more than others, as that of a frequent key does, is divided into parts that are
owned one by one. Balancing and growing edit the stored map and never rehash
records. Only the map and two sums per part reach the driver: at most ``SLOTS`` and
``2 * PER_SHARD`` rows for each shard, whatever the size of the table.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_right, insort
from collections import Counter
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from verbatim.llm.common import saved
from verbatim.sources.scratch import scratch_path

#: Number of virtual slots; fixed for the life of a table.
SLOTS = 8192
#: A slot is divided if it holds more than one in so many of a shard's even share.
PER_SHARD = 50
#: Bytes counted for each record besides its text.
ROW_BYTES = 16


@dataclass(frozen=True)
class SlotMap:
    """Which shard owns each part of each slot, in order, and how often the map was edited.

    ``parts`` has the number of parts of each slot; empty, every slot is one.
    """

    version: int
    shards: int
    owner: tuple[int, ...]
    parts: tuple[int, ...] = ()

    def entries(self) -> list[tuple[int, int, int]]:
        """Slot, part and owner of each entry."""
        places = [(s, p) for s, n in enumerate(self.parts or (1,) * len(self.owner)) for p in range(n)]
        return [(s, p, o) for (s, p), o in zip(places, self.owner, strict=True)]

    def divided(self, load: dict[int, int]) -> SlotMap:
        """Slots with far more bytes than others in more parts, whose owners stay; parts are never put together again."""
        limit = sum(load.values()) / (PER_SHARD * self.shards)
        owners: dict[int, list[int]] = {}
        for slot, _, owner in self.entries():
            owners.setdefault(slot, []).append(owner)
        for slot, size in load.items():
            if size > limit and size > len(owners[slot]) * limit:
                owners[slot] = [owners[slot][p % len(owners[slot])] for p in range(math.ceil(size / limit))]
        every = [owners[s] for s in sorted(owners)]
        return replace(self, owner=tuple(o for part in every for o in part), parts=tuple(map(len, every)))

    @staticmethod
    def even(shards: int, slots: int = SLOTS) -> SlotMap:
        """The first version: slots dealt out in turn."""
        return SlotMap(1, shards, tuple(s % shards for s in range(slots)))

    def _edited(self, owner: list[int], shards: int) -> SlotMap:
        return replace(self, version=self.version + 1, shards=shards, owner=tuple(owner))

    def rebalanced(self, load: dict[int, int]) -> SlotMap:
        """Move entries (numbers in ``owner``) from the fullest to the emptiest shard while that narrows their gap."""
        owner = list(self.owner)
        total = [0] * self.shards
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot, size in sorted(load.items()):
            total[owner[slot]] += size
            held[owner[slot]].append((size, slot))
        for slots in held:
            slots.sort()
        full, free = [(-t, s) for s, t in enumerate(total)], [(t, s) for s, t in enumerate(total)]
        heapq.heapify(full)
        heapq.heapify(free)
        while True:
            while -full[0][0] != total[full[0][1]]:
                heapq.heappop(full)
            while free[0][0] != total[free[0][1]]:
                heapq.heappop(free)
            high, low = full[0][1], free[0][1]
            gap = total[high] - total[low]
            at = bisect_right(held[high], (gap // 2, len(owner)))
            near = [k for k in (at - 1, at) if 0 <= k < len(held[high]) and 0 < held[high][k][0] < gap]
            if not near:
                break
            size, slot = held[high].pop(min(near, key=lambda k: abs(2 * held[high][k][0] - gap)))
            insort(held[low], (size, slot))
            owner[slot] = low
            for shard, change in ((high, -size), (low, size)):
                total[shard] += change
                heapq.heappush(full, (-total[shard], shard))
                heapq.heappush(free, (total[shard], shard))
        return self._edited(owner, self.shards)

    def grown(self, load: dict[int, int]) -> SlotMap:
        """One more shard; it takes its share of bytes entry by entry, and none moves between old shards."""
        owner, total = list(self.owner), [0] * (self.shards + 1)
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.shards)]
        for slot in range(len(owner)):
            total[owner[slot]] += load.get(slot, 0)
            held[owner[slot]].append((load.get(slot, 0), slot))
        share = sum(total) / (self.shards + 1)
        full = [(-t, s) for s, t in enumerate(total[:-1])]
        heapq.heapify(full)
        while total[-1] < share:
            _, shard = heapq.heappop(full)
            if not held[shard]:
                break
            size, slot = held[shard].pop()
            owner[slot] = self.shards
            total[shard] -= size
            total[-1] += size
            heapq.heappush(full, (-total[shard], shard))
        return self._edited(owner, self.shards + 1)

    def store(self, spark: SparkSession, folder: str) -> str:
        """Write this version beside earlier ones; a version that exists is never overwritten."""
        path = f"{folder.rstrip('/')}/version={self.version}"
        rows = [(*entry, self.shards) for entry in self.entries()]
        spark.createDataFrame(rows, "slot int, part int, shard int, shards int").coalesce(1).write.parquet(path)
        return path

    @staticmethod
    def load(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
        """A stored version, the newest by default."""
        table = spark.read.parquet(folder)
        if version is None:
            version = table.agg(F.max("version")).first()[0]
        rows = sorted(table.where(F.col("version") == version).select("slot", "part", "shard", "shards").collect())
        count = Counter(r.slot for r in rows)
        parts = tuple(count[s] for s in sorted(count)) if max(count.values()) > 1 else ()
        return SlotMap(version, rows[0].shards, tuple(r.shard for r in rows), parts)

    @staticmethod
    def stored(spark: SparkSession, folder: str) -> bool:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def virtual_slot(key: str, text: str, slots: int = SLOTS):
    """Slot of a record: hash of its key; records without a key are spread by their text."""
    return F.pmod(F.xxhash64(F.col(key), F.when(F.col(key).isNull(), F.col(text))), F.lit(slots)).cast("int")


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", slots: int = SLOTS, map_folder: str | None = None) -> DataFrame:
    """Place every record in a shard of near equal bytes.

    The newest map in ``map_folder`` is loaded and edited, so that a later run moves
    few records; without one, slots are dealt out in turn. A map of fewer shards grows
    first. The edited map is stored as the next version. The text is read once; what
    follows works on five small columns.

    Null text: no bytes, checksum 0. Equal keys share a slot, but not always a part of
    it: the rows of a frequent key are dealt over several shards, also rows that are
    equal in all. Null keys are spread by their text. An empty table gives no rows.
    Other columns of ``df`` are ignored.

    Returns the key, size, text_crc32, shard, slot (place in its shard, from 0
    without gaps), virtual_slot, part and map_version.
    """
    spark = df.sparkSession
    rows = saved(
        df.select(
            F.col(key).alias("_key"),
            (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
            virtual_slot(key, text, slots).alias("virtual_slot"),
            # Fixed by the write; decides the part of a row whose slot is divided.
            F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30)).cast("int").alias("_spread"),
        ),
        "shard-rows",
    )
    folder = map_folder or scratch_path(spark, "slot-map")
    if SlotMap.stored(spark, folder):
        first = SlotMap.load(spark, folder)
    else:
        first = SlotMap.even(shards, slots)
        first.store(spark, folder)
    if first.shards > shards or len(first.parts or first.owner) != slots:
        raise ValueError(f"the stored map has {first.shards} shards and {len(first.parts or first.owner)} slots")

    def loads(by: SlotMap) -> tuple[dict[int, int], list[int]]:
        """Bytes and rows of each entry."""
        place = {(s, p): k for k, (s, p, _) in enumerate(by.entries())}
        stats = parted(by).groupBy("virtual_slot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
        counts = [0] * len(place)
        for r in stats:
            counts[place[r.virtual_slot, r.part]] = r.n
        return {place[r.virtual_slot, r.part]: r.bytes for r in stats}, counts

    def parted(by: SlotMap) -> DataFrame:
        if not by.parts:
            return rows.withColumn("part", F.lit(0))
        # One row per slot.
        parts = F.broadcast(spark.createDataFrame(list(enumerate(by.parts)), "virtual_slot int, _parts int"))
        return rows.join(parts, "virtual_slot").withColumn("part", F.pmod("_spread", "_parts")).drop("_parts")

    by_slot = {r.virtual_slot: r.bytes for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}
    edited = first.divided(by_slot)
    load, count = loads(edited)
    while edited.shards < shards:
        edited = edited.grown(load)
    edited = replace(edited.rebalanced(load), version=first.version + 1)
    edited.store(spark, folder)

    start, plan = [0] * shards, []
    for (slot, part, owner), n in zip(edited.entries(), count, strict=True):
        plan.append((slot, part, owner, start[owner]))
        start[owner] += n
    # One row per entry: bounded by ``slots`` and the number of shards.
    owners = F.broadcast(spark.createDataFrame(plan, "virtual_slot int, part int, shard int, _base long"))
    # No entry holds more than a small share of all rows.
    in_part = Window.partitionBy("virtual_slot", "part").orderBy("_key", "text_crc32", "size")
    return (
        parted(edited).withColumn("_place", F.row_number().over(in_part) - 1)
        .join(owners, ["virtual_slot", "part"])
        .select(
            F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_base") + F.col("_place")).alias("slot"),
            "virtual_slot", "part", F.lit(edited.version).alias("map_version"),
        )
    )
