"""Sharding by fixed virtual slots.

A record's id hashes it into one of ``SLOTS`` virtual slots. Bytes are summed per
slot, and a slot map says which shard holds each slot. Maps are versioned: version
1 deals the slots out in turn, and each rebalancing makes the next version by an
edit that moves or swaps few slots until the shards' bytes are near equal. Stored
maps keep all versions, each written once, so a reader may pin one.

The law is ``bytes``: shards have near equal sizes. Only the per-slot sums, a fixed
number of rows, come to the driver.

Rows of a shard are numbered without gaps: within each slot and one of ``PARTS`` parts
of it by id, with offsets from the counts per slot and part. No task ever holds a
whole shard, and the texts are not shuffled.

An id that very many rows repeat (or few long ones), more than a slot can hold of a
balanced shard, is found from its slot's bytes; its rows go to all slots in turn. All other
rows of one id share its slot.

Defined results: a null text has no bytes (size 8, checksum 0); a null id is a value
like any other. Ties (equal id, checksum and size) are numbered in any order, as such
rows are equal. Of very long texts only size and checksum are kept. Other columns are
not read, whatever their names. An empty table gives none.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmesh.llm.common import shared_folder, table

SLOTS, PARTS, SHARDS, OVERHEAD = 4096, 16, 24, 8


@dataclass(frozen=True)
class SlotMap:
    """``shards[s]`` is the shard of slot s."""

    version: int
    n_shards: int
    shards: tuple[int, ...]

    @staticmethod
    def first(n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        return SlotMap(1, n_shards, tuple(s % n_shards for s in range(n_slots)))

    def rebalanced(self, slot_bytes: np.ndarray, n_shards: int | None = None, most_edits: int | None = None) -> SlotMap:
        """The next version. Each edit narrows the gap between the heaviest and the lightest shard.

        An edit moves the slot of the heaviest shard whose size is nearest half the
        gap to the lightest, or swaps the two slots whose sizes differ by nearest to
        that; edits end when none narrows the gap.
        """
        n = n_shards or self.n_shards
        shard = np.array(self.shards) % n
        weight = np.bincount(shard, slot_bytes, n).astype(np.int64)
        for _ in range(most_edits or 4 * len(shard)):
            high, low = int(weight.argmax()), int(weight.argmin())
            gap = int(weight[high] - weight[low])
            a, b = np.flatnonzero((shard == high) & (slot_bytes > 0)), np.flatnonzero(shard == low)
            b = b[np.argsort(slot_bytes[b], kind="stable")]
            # what leaves: slot i for slot j of the lightest, or for none
            own, other = slot_bytes[a], np.concatenate([[0], slot_bytes[b]]).astype(np.int64)
            want = own - gap / 2
            at = np.clip(np.searchsorted(other, want), 0, len(other) - 1)
            best = None
            for k in (at, np.maximum(at - 1, 0)):
                moved = own - other[k]
                off = np.where((moved > 0) & (moved < gap), np.abs(moved - gap / 2), np.inf)
                i = int(off.argmin()) if len(off) else 0
                if len(off) and np.isfinite(off[i]) and (best is None or off[i] < best[0]):
                    best = (off[i], a[i], int(k[i]), int(moved[i]))
            if best is None:
                break
            _, i, k, moved = best
            shard[i] = low
            if k:
                shard[b[k - 1]] = high
            weight[high] -= moved
            weight[low] += moved
        return SlotMap(self.version + 1, n, tuple(int(x) for x in shard))

    def rows(self, spark: SparkSession) -> DataFrame:
        n = len(self.shards)
        return spark.createDataFrame([(self.version, self.n_shards, n, s, x) for s, x in enumerate(self.shards)], "version int, n_shards int, n_slots int, vslot int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Adds this version to the stored maps under ``path``; a version that is there already is an error."""
        self.rows(spark).drop("version").coalesce(1).write.mode("error").parquet(f"{path}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
        """A stored version, by default the latest. One that does not have each of its slots once is an error."""
        maps = spark.read.parquet(path)
        version = version or maps.agg(F.max("version")).first()[0]
        rows = sorted(maps.where(F.col("version") == version).select("vslot", "shard", "n_shards", "n_slots").collect())  # one row for each slot
        if not rows or [r.vslot for r in rows] != list(range(rows[0].n_slots)) or len({r.n_shards for r in rows}) > 1 or not all(0 <= r.shard < r.n_shards for r in rows):
            raise ValueError(f"slot map version {version} under {path} is not whole")
        return SlotMap(version, rows[0].n_shards, tuple(r.shard for r in rows))


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_slots: int = SLOTS, hot: tuple = ()) -> DataFrame:
    """``doc_id, size, text_crc32, vslot, part`` of each row; the rows of ``hot`` ids are dealt out in turn."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(F.col(id_col))
    if hot:
        own = F.coalesce(F.col(id_col).isin(*[i for i in hot if i is not None]), F.lit(None in hot)) if set(hot) - {None} else F.col(id_col).isNull()
        h = F.when(own, F.xxhash64(F.monotonically_increasing_id())).otherwise(h)  # the place in the files, the same in each pass
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        h.alias("h"),
    ).select("doc_id", "size", "text_crc32", F.pmod("h", F.lit(n_slots)).cast("int").alias("vslot"), F.pmod(F.floor(F.col("h") / n_slots), F.lit(PARTS)).cast("int").alias("part"))


def hot_ids(rows: DataFrame, slot_bytes: np.ndarray, n_shards: int = SHARDS) -> tuple:
    """Ids that alone hold more than a quarter of a shard's bytes: ``4 n_shards`` at most, looked for in slots that are so heavy."""
    most = int(slot_bytes.sum()) // (4 * n_shards)
    heavy = np.flatnonzero(slot_bytes > most).tolist()
    if not heavy:
        return ()
    sizes = rows.where(F.col("vslot").isin(*heavy)).groupBy("doc_id").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))
    return tuple(r.doc_id for r in sizes.where((F.col("size") > most) & (F.col("n") > 1)).select("doc_id").collect())


def slot_sums(rows: DataFrame, n_slots: int = SLOTS) -> tuple[np.ndarray, dict[tuple[int, int], int]]:
    """Bytes per slot, and rows per slot and part."""
    size, counts = np.zeros(n_slots, np.int64), {}
    for r in rows.groupBy("vslot", "part").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect():  # SLOTS x PARTS rows at most
        size[r.vslot] += r["size"]
        counts[r.vslot, r.part] = r.n
    return size, counts


def assign(rows: DataFrame, slot_map: SlotMap, counts: dict[tuple[int, int], int]) -> DataFrame:
    """Adds ``shard`` and ``slot``, the gapless place in the shard."""
    offsets, end = [], [0] * slot_map.n_shards
    for (vslot, part), n in sorted(counts.items()):
        shard = slot_map.shards[vslot]
        offsets.append((vslot, part, shard, end[shard]))
        end[shard] += n
    places = rows.sparkSession.createDataFrame(offsets, "vslot int, part int, shard int, start long")
    within = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size")
    numbered = rows.withColumn("at", F.row_number().over(within))
    # SLOTS x PARTS rows at most: a fixed size
    return numbered.join(F.broadcast(places), ["vslot", "part"]).withColumn("slot", F.col("start") + F.col("at") - 1)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = records(docs)
    size, counts = slot_sums(rows)
    if hot := hot_ids(rows, size):
        rows = records(docs, hot=hot)
        size, counts = slot_sums(rows)
    maps = f"{shared_folder(spark)}/slot-maps-{uuid.uuid4().hex}"
    start = SlotMap.first(SHARDS)
    for version in (start, start.rebalanced(size)):
        version.save(spark, maps)
    slot_map = SlotMap.load(spark, maps)
    return assign(rows, slot_map, counts).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(slot_map.version).alias("map_version"))
