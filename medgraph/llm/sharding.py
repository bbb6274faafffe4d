"""Sharding by fixed virtual slots.

Every record hashes into one of thousands of slots, and only slots move between shards. Bytes are summed per slot. A
map from slot to shard is stored under a name, one version after another: version 1 deals the slots out evenly, and a
rebalancing reads the newest version, moves as few slots as the measured bytes ask for, and stores the next one. Copies
of a text share a slot, unless they outweigh a whole shard: such a group is spread over all slots by doc_id.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, insort

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import clean_docs, numbered, saved, shared_dir

SLOTS = 4096
SHARDS = 8
_SLOT_SEED = 9
MAP = "version int, virtual_slot int, shard int, bytes long"


def records(docs: DataFrame) -> DataFrame:
    """(doc_id, size, text_crc32, text_hash): size is the UTF-8 bytes of the text (null: none) and 1."""
    text = F.coalesce("text", F.lit(""))
    return clean_docs(docs).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"))


def slotted(rows: DataFrame, slots: int = SLOTS, shards: int = SHARDS) -> DataFrame:
    """``records`` with the virtual slot of each. Equal texts share one, but for groups heavier than a shard's share of
    all bytes, of which there are fewer than shards."""
    total = rows.agg(F.sum("size").alias("t")).first()["t"] or 0
    groups = rows.groupBy("text_hash").agg(F.sum("size").alias("bytes"))
    heavy = [r["text_hash"] for r in groups.filter(F.col("bytes") * shards > F.lit(total)).select("text_hash").collect()]
    by_text = F.pmod(F.xxhash64("text_hash", F.lit(_SLOT_SEED)), F.lit(slots))
    by_id = F.pmod(F.xxhash64("text_hash", "doc_id", F.lit(_SLOT_SEED)), F.lit(slots))
    return rows.withColumn("virtual_slot", F.when(F.col("text_hash").isin(heavy), by_id).otherwise(by_text).cast("int"))


def slot_sizes(rows: DataFrame, slots: int = SLOTS) -> tuple[list[int], list[int]]:
    """Bytes and rows of each slot: twice ``slots`` numbers."""
    sizes, counts = [0] * slots, [0] * slots
    for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect():
        sizes[r["virtual_slot"]], counts[r["virtual_slot"]] = r["bytes"], r["n"]
    return sizes, counts


def first_map(slots: int, shards: int = SHARDS) -> list[int]:
    """Shard of each slot before any byte is known: dealt out in turn."""
    return [slot % shards for slot in range(slots)]


def edit_map(current: list[int], sizes: list[int], shards: int) -> list[int]:
    """The next version for ``shards`` shards. Slots move one by one from the heaviest shard to the lightest, each time
    the one that comes nearest to halving their difference, while that makes them more equal. Where shards are added,
    slots go to those alone."""
    out, old = list(current), max(current) + 1
    held: list[list[tuple[int, int]]] = [[] for _ in range(max(shards, old))]
    load = [0] * len(held)
    for slot, shard in enumerate(current):
        load[shard] += sizes[slot]
        insort(held[shard], (sizes[slot], slot))
    targets = list(range(old, shards)) or list(range(shards))
    for _ in range(4 * len(current)):
        source, to = max(range(len(load)), key=lambda s: (load[s], -s)), min(targets, key=lambda s: (load[s], s))
        gap = load[source] - load[to]
        at = bisect_left(held[source], (gap // 2 + 1, -1))
        near = [held[source][k] for k in (at - 1, at) if 0 <= k < len(held[source]) and 0 < held[source][k][0] < gap]
        if source == to or not near:
            break
        size, slot = min(near, key=lambda x: (abs(2 * x[0] - gap), x))
        held[source].remove((size, slot))
        insort(held[to], (size, slot))
        load[source], load[to], out[slot] = load[source] - size, load[to] + size, to
    return out


def store_map(spark: SparkSession, name: str, version: int, shard_of: list[int], sizes: list[int] | None = None) -> DataFrame:
    """Store a version of the named map in the shared folder, one row per slot, and read it back. A version is never
    written over."""
    rows = [(version, slot, shard, sizes[slot] if sizes else None) for slot, shard in enumerate(shard_of)]
    spark.createDataFrame(rows, MAP).coalesce(1).write.parquet(f"{shared_dir(spark)}/slot-maps/{name}/v{version}")
    return load_map(spark, name, version)


def load_map(spark: SparkSession, name: str, version: int) -> DataFrame:
    """A stored version: (version, virtual_slot, shard, bytes)."""
    return spark.read.schema(MAP).parquet(f"{shared_dir(spark)}/slot-maps/{name}/v{version}")


def rebalance(spark: SparkSession, name: str, version: int, sizes: list[int], shards: int) -> DataFrame:
    """Read the stored version, edit it for these slot sizes and so many shards, and store the next one."""
    current = [r["shard"] for r in load_map(spark, name, version).orderBy("virtual_slot").collect()]
    return store_map(spark, name, version + 1, edit_map(current, sizes, shards), sizes)


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, name: str | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    The law is ``bytes``: shards hold near equal bytes. ``slot`` numbers a shard's rows from 0 without gaps, by virtual
    slot and doc_id. Null and empty texts have size 1. Repeated rows, and rows without an id, are rows like any other.
    ``grown_shard`` is null, as the law asks; ``rebalance`` grows a map. Very long texts are one row like any other. An
    empty table gives no rows; other columns are not read. The map's versions are stored under ``name``, or under one
    of their own.
    """
    spark, name = docs.sparkSession, name or uuid.uuid4().hex
    rows = saved(slotted(saved(records(docs), "records"), slots, shards), "slotted")  # texts are read once
    sizes, counts = slot_sizes(rows, slots)
    store_map(spark, name, 1, first_map(slots, shards))
    shard_of = rebalance(spark, name, 1, sizes, shards)
    # rows are numbered through all slots by a range sort, which cuts a heavy slot between tasks; what a slot's numbers
    # are moved by follows from the counts of the map's fixed number of slots
    moves, before, held = [], 0, [0] * shards
    for r in shard_of.orderBy("virtual_slot").collect():
        slot, shard = r["virtual_slot"], r["shard"]
        moves.append((slot, shard, r["version"], held[shard] - before))
        before, held[shard] = before + counts[slot], held[shard] + counts[slot]
    moved = spark.createDataFrame(moves, "virtual_slot int, shard int, version int, move long")
    placed = numbered(rows, ["virtual_slot", "doc_id", "text_crc32"], "at")
    return placed.join(F.broadcast(moved), "virtual_slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") + F.col("move")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))
