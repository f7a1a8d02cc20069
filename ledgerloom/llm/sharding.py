"""Sharding by fixed virtual slots.

Records hash by id and text into a fixed number of slots that never changes; those without id, which may be many copies of one
text, also by their place in the stored table. Bytes are added up per slot, and a
versioned map assigns slots to shards. Balancing or adding a shard edits the map only: a record's
slot stays, and whole slots move.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, delete, scratch, text_or_empty

#: Virtual slots; fixed for the life of a data set.
SLOTS = 4096


def records(docs: DataFrame, scratch: Scratch, slots: int = SLOTS) -> DataFrame:
    """doc_id, size (UTF-8 bytes and 1), text_crc32 and virtual_slot, stored."""
    body = text_or_empty()
    one = docs.select("doc_id", (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.xxhash64(body).alias("th"), F.monotonically_increasing_id().alias("at"))
    one = scratch.put("records", one)  # places must not change between the two passes
    place = F.when(F.col("doc_id").isNull(), F.col("at")).otherwise(0)
    return one.select("doc_id", "size", "text_crc32", F.pmod(F.xxhash64("doc_id", "th", place), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(recs: DataFrame) -> DataFrame:
    """At most ``slots`` rows: virtual_slot, n_rows, n_bytes."""
    return recs.groupBy("virtual_slot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def first_map(shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Version 1: slots dealt round."""
    return {s: s % shards for s in range(slots)}


def rebalance(slot_to_shard: Mapping[int, int], n_bytes: Mapping[int, int], shards: int) -> dict[int, int]:
    """The next version of the map, over ``shards`` shards: slots move from the fullest shard to the emptiest.

    A move or swap is made only if it brings the two shards nearer, so the sum of squared sizes falls each time
    and the moves end; then no single slot, and none of the swaps tried, would bring them nearer.
    """
    held: dict[int, list[int]] = {k: [] for k in range(shards)}
    out = dict(slot_to_shard)
    for s in sorted(out):
        if out[s] >= shards:
            out[s] = s % shards
        held[out[s]].append(s)
    size = {k: sum(n_bytes.get(s, 0) for s in v) for k, v in held.items()}
    while True:
        low, top = min(size, key=lambda k: (size[k], k)), max(size, key=lambda k: (size[k], -k))
        gap = size[top] - size[low]
        fits = [(n_bytes.get(s, 0), -s) for s in held[top] if 0 < n_bytes.get(s, 0) < gap]
        if not fits:
            break
        # the slot nearest to half the gap
        n, s = min(fits, key=lambda x: (abs(2 * x[0] - gap), x))
        best, pair = abs(gap - 2 * n), (-s, None)
        lows = sorted((n_bytes.get(s, 0), s) for s in held[low])
        for m, t in heapq.nlargest(64, ((n_bytes.get(s, 0), s) for s in held[top])):
            want = m - gap / 2
            if want > 0 and lows:
                near = min(lows, key=lambda x: abs(x[0] - want))
                if abs(gap - 2 * (m - near[0])) < best:
                    best, pair = abs(gap - 2 * (m - near[0])), (t, near[1])
        if best >= gap:
            break
        for s, a, b in ((pair[0], top, low), (pair[1], low, top)):
            if s is not None:
                held[a].remove(s)
                held[b].append(s)
                size[a] -= n_bytes.get(s, 0)
                size[b] += n_bytes.get(s, 0)
                out[s] = b
    return out


def write_map(spark: SparkSession, slot_to_shard: Mapping[int, int], version: int, path: str) -> None:
    """Adds a version; earlier ones stay readable under their own partitions."""
    rows = [(k, v) for k, v in sorted(slot_to_shard.items())]
    spark.createDataFrame(rows, "virtual_slot int, shard int").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}")


def place(recs: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard and slot: the record's place in its shard, gapless from 0, by virtual slot, then doc_id.

    Ranks are found within virtual slots, of which there are thousands; a shard's slots are then set
    one after the other by a running sum over the slot table, so no shard is gathered in one task.
    """
    from pyspark.sql import Window as W

    starts = slot_bytes(recs).join(F.broadcast(slot_map), "virtual_slot")  # one row a slot: bounded by the map
    starts = starts.withColumn("start", F.sum("n_rows").over(W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)))
    starts = starts.select("virtual_slot", "shard", F.coalesce("start", F.lit(0)).alias("start"))
    ranked = recs.withColumn("rank", F.row_number().over(W.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")))
    return ranked.join(F.broadcast(starts), "virtual_slot").withColumn("slot", (F.col("start") + F.col("rank") - 1).cast("long"))


def op5_sharding(docs: DataFrame, shards: int = 16, slots: int = SLOTS) -> DataFrame:
    """All documents in ``shards`` shards of near equal bytes (law ``bytes``).

    Null texts have size 1. Rows without id are spread one by one, rows that share an id by their text; rows equal in both share a
    virtual slot, next to each other. Very long texts count with their bytes: no shard can be smaller than its largest text. An
    empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with Scratch(spark) as held:
        recs = records(docs, held, slots)
        path = scratch(spark, "shard-map")
        sizes = {r["virtual_slot"]: r["n_bytes"] for r in slot_bytes(recs).collect()}  # one row a slot
        write_map(spark, first := first_map(shards, slots), 1, path)
        write_map(spark, rebalance(first, sizes, shards), 2, path)
        placed = place(recs, read_map(spark, path, 2))
        out = held.put("placed", placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"))
        held.keep("placed")
        delete(spark, path)  # the query's own map; ``write_map`` keeps versions for a data set that stays
    return out
