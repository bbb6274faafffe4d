"""Exact dedup with an extendible-hash index on shared files.

Every text has a 64-bit hash. The directory looks at the first bits of a hash; a bucket that holds more keys than its
capacity is split in two by one more bit, and the directory doubles when a bucket needs more bits than it has. Texts
go to the bucket that the directory names, copies that meet in one batch already combined, so a huge group of copies
sends a row per batch. Owner tasks hold ranges of keys (whole buckets): they walk each bucket in key order, compare the
bytes of the texts that share a hash, chain those that differ, and write the bucket's entries to the shared folder.
Rows find their entry, and with it the row that stays, by hash and SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_docs, fresh, saved

#: Entries of a bucket before it splits.
CAPACITY = 4096
#: Bits that a directory may look at. Bounds it to 65,536 places, whatever the corpus. A bucket there may overflow: its
#: owner walks it in key order and holds one chain at a time, so it is only longer.
MAX_DEPTH = 16
FIRST_DEPTH = 3


@dataclass
class Directory:
    """Extendible-hash directory over counts of entries by their first MAX_DEPTH bits."""

    counts: dict[int, int]
    capacity: int = CAPACITY
    max_depth: int = MAX_DEPTH
    depth: int = FIRST_DEPTH
    #: (prefix, depth) -> entries
    buckets: dict[tuple[int, int], int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        todo = [(p, self.depth, {}) for p in range(1 << self.depth)]
        for cell, n in self.counts.items():
            todo[cell >> (self.max_depth - self.depth)][2][cell] = n
        while todo:
            prefix, depth, cells = todo.pop()
            total = sum(cells.values())
            if total <= self.capacity or depth == self.max_depth:
                self.buckets[prefix, depth] = total
                continue
            if depth == self.depth:
                self.depth += 1  # the directory doubles
            halves: tuple[dict, dict] = ({}, {})
            for cell, n in cells.items():
                halves[cell >> (self.max_depth - depth - 1) & 1][cell] = n
            todo += [(2 * prefix + bit, depth + 1, halves[bit]) for bit in (0, 1)]

    def places(self) -> list[tuple[int, int, int]]:
        """(place, bucket, local depth) of each of the 2**depth places; several places may share a bucket."""
        out = []
        for number, (prefix, depth) in enumerate(sorted(self.buckets, key=lambda b: b[0] << (self.max_depth - b[1]))):
            step = self.depth - depth
            out += [(place, number, depth) for place in range(prefix << step, (prefix + 1) << step)]
        return out


INDEX = "bucket int, depth int, hash long, chain int, text_sha256 string, group_size long, keep_id long"
_ARROW = pa.schema([("bucket", pa.int32()), ("depth", pa.int32()), ("hash", pa.int64()), ("chain", pa.int32()), ("text_sha256", pa.string()), ("group_size", pa.int64()), ("keep_id", pa.int64())])


def _hashed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return clean_docs(docs).select("doc_id", text.alias("text"), F.xxhash64(text).alias("hash"))


def _cell() -> F.Column:
    return F.shiftrightunsigned("hash", 64 - MAX_DEPTH).cast("int")


def directory(hashes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(cell, bucket, depth) for every cell of MAX_DEPTH bits, from the distinct keys of each: 2**MAX_DEPTH counts at
    most reach the driver."""
    counts = {r["cell"]: r["n"] for r in hashes.select("hash").distinct().groupBy(_cell().alias("cell")).agg(F.count("*").alias("n")).collect()}
    made = Directory(counts, capacity)
    rows = [(place << (MAX_DEPTH - made.depth) | low, bucket, depth) for place, bucket, depth in made.places() for low in range(1 << (MAX_DEPTH - made.depth))]
    return hashes.sparkSession.createDataFrame(rows, "cell int, bucket int, depth int")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a batch as one row: how many, and their largest id."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["bucket", "depth", "hash", "text"]).aggregate([("doc_id", "max"), ([], "count_all")])
        yield from table.select(["bucket", "depth", "hash", "text", "doc_id_max", "count_all"]).rename_columns(["bucket", "depth", "hash", "text", "keep_id", "group_size"]).to_batches()


@dataclass
class _Entry:
    text: bytes
    size: int
    keep: int | None


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of bucket and hash to index entries: each key's chain, compared byte by byte."""
    key: tuple | None = None
    chain: list[_Entry] = []
    rows: list[tuple] = []

    def close() -> None:
        for at, e in enumerate(sorted(chain, key=lambda e: e.text), 1):
            rows.append((*key, at, hashlib.sha256(e.text).hexdigest(), e.size, e.keep))

    def out() -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(_ARROW)
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    for batch in batches:
        texts = batch.column(3).cast(pa.binary())
        for k, (bucket, depth, hash_, keep, size) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4, 5)), strict=True)):
            if key != (bucket, depth, hash_):
                if chain:
                    close()
                key, chain = (bucket, depth, hash_), []
            text = texts[k].as_py()
            for e in chain:
                if e.text == text:
                    e.size += size
                    e.keep = keep if e.keep is None else e.keep if keep is None else max(e.keep, keep)
                    break
            else:
                chain.append(_Entry(text, size, keep))
        yield out()
    if chain:
        close()
        yield out()


def build_index(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The index as a written table, one row per distinct text: (bucket, depth, hash, chain, text_sha256, group_size,
    keep_id), each bucket's rows in one file and in key order. ``chain`` numbers the texts that share a hash."""
    hashed = _hashed(docs)
    placed = hashed.withColumn("cell", _cell()).join(F.broadcast(directory(hashed, capacity)), "cell").select("bucket", "depth", "hash", "text", "doc_id")
    few = placed.mapInArrow(_combine, "bucket int, depth int, hash long, text string, keep_id long, group_size long")
    return saved(few.repartition("bucket").sortWithinPartitions("bucket", "hash").mapInArrow(_own, INDEX), "index")


def exact_groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, and its place in the key's chain.

    Texts are equal when identical; null counts as empty. Of equal texts the largest doc_id stays; null ids never win
    against another id. Rows that repeat both doc_id and text are one record: they carry the same ``kept``. Very long
    texts are one row like any other. Empty tables give no rows. Other columns of ``docs``, whatever their names, are
    not read.
    """
    groups = build_index(docs, capacity).filter("group_size > 1 OR chain > 1").select("hash", "text_sha256", "group_size", "keep_id", "chain")
    rows = _hashed(docs).withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256)).drop("text").join(groups, ["hash", "text_sha256"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.coalesce("chain", F.lit(1)).alias("chain"))


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text a row with a larger doc_id holds too; repeated rows leave one.

    Null counts as an empty text, and a null doc_id as smaller than any; of equal texts that have none, one row stays.
    Texts of any length are compared whole. Other columns, whatever their names, come through unchanged. An empty table
    stays empty.
    """
    found = exact_groups(docs)
    i, sha, kept_id, kept_sha = fresh(docs, "id_of_row", "sha_of_row", "kept_id", "kept_sha")
    keep = found.filter("kept").select(F.col("doc_id").alias(kept_id), F.col("text_sha256").alias(kept_sha)).distinct()
    keyed = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).withColumn(i, F.col("doc_id").cast("long"))
    marked = keyed.join(keep, F.col(i).eqNullSafe(F.col(kept_id)) & (F.col(sha) == F.col(kept_sha)), "left_semi")
    return marked.dropDuplicates([i, sha]).drop(i, sha)
