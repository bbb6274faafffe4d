"""SimHash near-dedup with BK-trees.

A document's fingerprint is the bitwise majority of its shingles' hashes. Distinct fingerprints are dealt to shards so
that two within the radius meet in one: with radius r, fingerprints cut into r + 1 bit groups agree on one group at
least. A shard that is still too large is dealt again by its remaining bits, so a shard's size has a fixed bound. Each
shard's fingerprints make a BK-tree, whose children are keyed by their Hamming distance to the parent. The trees are
broadcast while their measured size is small, and joined by shard beyond it; each fingerprint descends its shards'
trees along edges within the radius only. A task emits a spanning forest of the links that it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import squares
from .components import components
from .shared import clean_docs, fresh, saved

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints of a shard tree. At 8 free bits a shard can't be larger than this.
TREE_NODES = 256
#: Trees of at most so many bytes, as measured, are broadcast.
BROADCAST_BYTES = 4 << 20
_HASHES = 200_000


#: Fixed value: bytes that may stand around a word.
_PUNCTUATION = b".,;:!?\"'()[]"


def _fingerprints(words_per_shingle: int, distinct: bool = False):
    def hashes(text: bytes) -> np.ndarray:
        ws = text.lower().split()
        if distinct:
            ws = sorted({w.strip(_PUNCTUATION) or w for w in ws})
        if not ws:
            return np.zeros(0, dtype=np.uint64)
        n = max(1, len(ws) - words_per_shingle + 1)
        shingles = map(b" ".join, zip(*(ws[i : i + n] for i in range(words_per_shingle)), strict=True)) if len(ws) >= words_per_shingle else [b" ".join(ws)]
        return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), dtype=np.uint64, count=n)

    def bits(h: np.ndarray) -> np.ndarray:
        return np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)

    def vote(h: np.ndarray) -> int:
        counts = np.zeros(64, dtype=np.int64)
        for at in range(0, len(h), _HASHES):  # a very long text in parts
            counts += bits(h[at : at + _HASHES]).sum(axis=0, dtype=np.int64)
        return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big", signed=True)

    def fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([vote(hashes(t or b"")) for t in texts], type=pa.int64())], names=["doc_id", "fp"])

    return fingerprint


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, distinct: bool = False) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash over shingles of lower-cased (A-Z) words; texts without words have 0. ``distinct``:
    over the text's distinct words, bare of punctuation, each once."""
    return clean_docs(docs).mapInArrow(_fingerprints(1 if distinct else shingle, distinct), "doc_id long, fp long")


def _groups(free: int, n: int) -> list[int]:
    """The set bits of ``free`` dealt to n masks, high bits first."""
    bits = [b for b in range(63, -1, -1) if free >> b & 1]
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _deal(df: DataFrame, masks: dict[int, list[int]]) -> DataFrame:
    """Rows (mask, fp) once for each wider mask that follows theirs."""
    table = df.sparkSession.createDataFrame([(_signed(m), _signed(w)) for m, wider in masks.items() for w in wider], "mask long, wider long")
    return df.join(F.broadcast(table), "mask").select(F.col("wider").alias("mask"), "fp")


def _shards(distinct: DataFrame, radius: int, limit: int) -> DataFrame:
    """(mask, value, fp): shards of at most ``limit`` fingerprints that together hold every pair within the radius.

    Masks form a fixed tree that halves nothing and drops nothing: each overfull shard is replaced by radius + 1 finer
    ones over its free bits. It ends, since ``limit`` fingerprints always fit where few bits are free.
    """
    every = (1 << 64) - 1
    level, done = {0: _groups(every, radius + 1)}, None
    todo = distinct.select(F.lit(0).cast("long").alias("mask"), "fp")
    while True:
        dealt = _deal(todo, level).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        masks = {w for wider in level.values() for w in wider}
        over = saved(dealt.groupBy("mask", "value").agg(F.count("*").alias("n")).filter(F.col("n") > limit).select("mask", "value"), "overfull")
        fine = over.isEmpty()
        keep = dealt if fine else dealt.join(over, ["mask", "value"], "left_anti")
        done = keep if done is None else done.unionByName(keep)
        if fine:
            return done
        todo = saved(dealt.join(over, ["mask", "value"], "left_semi").select("mask", "fp").distinct(), "overfull-rows")
        level = {m: [m | g for g in _groups(every & ~m, radius + 1)] for m in masks}


def build_tree(fps: list[int]) -> np.ndarray:
    """BK-tree as an array of (fingerprint, parent, distance to the parent), parents first."""
    children: list[dict[int, int]] = [{}]
    rows = [(fps[0], -1, 0)]
    for fp in fps[1:]:
        at = 0
        while (d := ((fp ^ rows[at][0]) & (2**64 - 1)).bit_count()) in children[at]:
            at = children[at][d]
        if d == 0:
            continue
        children[at][d] = len(rows)
        rows.append((fp, at, d))
        children.append({})
    return np.array(rows, dtype=np.int64)


class Tree:
    def __init__(self, packed: bytes):
        rows = np.frombuffer(packed, dtype=np.int64).reshape(-1, 3)
        self.fps = rows[:, 0].tolist()
        self.children: list[dict[int, int]] = [{} for _ in self.fps]
        for i, (_, parent, d) in enumerate(rows.tolist()):
            if parent >= 0:
                self.children[parent][d] = i

    def within(self, fp: int, radius: int) -> list[int]:
        found, stack = [], [0]
        while stack:
            at = stack.pop()
            d = ((fp ^ self.fps[at]) & (2**64 - 1)).bit_count()
            if d <= radius:
                found.append(self.fps[at])
            stack += [child for edge, child in self.children[at].items() if abs(edge - d) <= radius]
        return found


def _build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"mask": batch["mask"], "value": batch["value"], "tree": [build_tree(sorted(x.tolist())).tobytes() for x in batch["fps"]]})


def _search(radius: int):
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            up: dict[int, int] = {}

            def root(x: int, up: dict[int, int] = up) -> int:
                while (y := up.setdefault(x, x)) != x:
                    up[x] = up[y]
                    x = y
                return x

            trees: dict[bytes, Tree] = {}
            for fp, packed in zip(batch["fp"].tolist(), batch["tree"], strict=True):
                if packed not in trees:
                    trees[packed] = Tree(packed)
                for other in trees[packed].within(fp, radius):
                    x, y = root(fp), root(other)
                    if x != y:
                        up[max(x, y)] = min(x, y)
            found = [(x, root(x)) for x in up]
            yield pd.DataFrame([(x, y) for x, y in found if x != y], columns=["a", "b"], dtype="int64")

    return search


def links(fps: DataFrame, radius: int = RADIUS, limit: int = TREE_NODES) -> DataFrame:
    """(a, b): a spanning set of the links between distinct fingerprints at most ``radius`` bits apart."""
    shards = saved(_shards(fps.select("fp").distinct(), radius, limit), "shards")
    grouped = shards.groupBy("mask", "value").agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1)
    trees = saved(grouped.mapInPandas(_build, "mask long, value long, tree binary"), "trees")
    size = trees.agg(F.sum(F.length("tree") + 16).alias("n")).first()["n"] or 0
    side = F.broadcast(trees) if size <= BROADCAST_BYTES else trees
    return shards.join(side, ["mask", "value"]).select("fp", "tree").mapInPandas(_search(radius), "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, limit: int = TREE_NODES, distinct: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id that is
    reachable over links of at most ``radius`` differing bits.

    Null and empty texts, and texts without words, have fingerprint 0, linked like any other; a text of fewer words
    than a shingle is one shingle. Null ids count for no component_id, which is null where a group has no other.
    Repeated rows repeat. An empty table gives none.
    """
    fps = saved(fingerprints(docs, shingle, distinct), "fingerprints")
    roots = components(links(fps, radius, limit)).withColumnRenamed("node", "fp")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    group = first.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = group.groupBy("root").agg(F.min("first_id").alias("component_id"))
    by_fp = group.join(least, "root").select("fp", "component_id")
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For whole corpora: a copy with few words changed keeps its set of words nearly whole, so its fingerprint over them
#: lies within these bits, while shingles of several words move far more bits for each changed word.
WORD_SET_RADIUS = 3


#: Least five-word Jaccard similarity of near copies; MinHash bands, and values of each, that bring candidates together.
JACCARD = 0.8
JACCARD_SHINGLE = 5
BANDS, BAND_VALUES = 20, 5
#: Documents of one bucket, in order of id, meet so many that follow, and the first; what those leave apart, in squares.
FOLLOWING = 3
#: Text bytes of a side of a square.
SQUARE_BYTES = 4 << 20

_MIX = np.random.default_rng(SEED).integers(0, 1 << 64, size=(2, BANDS * BAND_VALUES), dtype=np.uint64, endpoint=False) | np.uint64(1)


def _shingles(text: bytes) -> np.ndarray:
    """Distinct hashes of a text's runs of five lower-cased (A-Z) words; a shorter text is one run."""
    ws = text.lower().split()
    h = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in ws), dtype=np.uint64, count=len(ws))
    n = max(1, len(h) - JACCARD_SHINGLE + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(JACCARD_SHINGLE, len(h))):  # order counts: each place has a step of its own
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, bands = [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            h, least = _shingles(text), None
            for at in range(0, len(h), 2_000):
                part = h[at : at + 2_000, None] * _MIX[0] + _MIX[1]
                part = ((part ^ (part >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)).min(axis=0)
                least = part if least is None else np.minimum(least, part)
            ids.append(doc_id)
            bands.append([xxhash.xxh64_intdigest(b.tobytes(), i) - (1 << 63) for i, b in enumerate(least.reshape(BANDS, BAND_VALUES))])
        yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(bands, type=pa.list_(pa.int64()))], names=["doc_id", "bands"])


def _alike(similarity: float):
    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, t = (batch.column(i).cast(pa.binary()).to_pylist() for i in (2, 3))
            keep = []
            for x, y in zip(s, t, strict=True):
                x, y = _shingles(x), _shingles(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return alike


def _alike_squares(similarity: float):
    def links(a: pa.Table, b: pa.Table) -> list[tuple]:
        open_ = squares.Open(a, b)
        x, y = ([_shingles(t) for t in side.column("text").cast(pa.binary()).to_pylist()] for side in (a, b))
        both = squares.shared(x, y)
        either = np.array([len(v) for v in x])[:, None] + np.array([len(v) for v in y]) - both
        pairs = np.argwhere(open_.pairs & (both >= similarity * either - 1e-9))
        return [found for i, j in pairs.tolist() if (found := open_.link(i, j))]

    return links


def near_copy_links(docs: DataFrame, radius: int = WORD_SET_RADIUS, similarity: float = JACCARD) -> DataFrame:
    """(a, b): doc_ids whose texts have at least this five-word Jaccard similarity, each pair compared.

    Candidates share a group of word-set fingerprints or a MinHash band. Of each such bucket every document first meets
    the first and the next few, so a bucket of m documents gives at most 4 m pairs. In larger buckets, all pairs that
    those links leave in different groups are compared too: the links connect whatever all pairs would.
    """
    texts = clean_docs(docs).filter("doc_id is not null")
    groups = near_groups(texts, radius=radius, distinct=True).select("doc_id", F.lit(-1).alias("band"), F.col("component_id").alias("bucket"))
    bands = texts.mapInArrow(_bands, "doc_id long, bands array<long>").select("doc_id", F.posexplode("bands").alias("band", "bucket"))
    order = Window.partitionBy("band", "bucket").orderBy("doc_id")
    met = [F.first("doc_id").over(order), *(F.lag("doc_id", i).over(order) for i in range(1, FOLLOWING + 1))]
    deep = F.lag("doc_id", FOLLOWING + 2).over(order).isNotNull()
    placed = groups.unionByName(bands).select(F.xxhash64("band", "bucket").alias("bucket"), F.col("doc_id").alias("b"), F.array(*met).alias("met"), deep.alias("deep"))
    placed = saved(placed.filter("met[1] is not null"), "near-places")
    pairs = saved(placed.select(F.explode("met").alias("a"), "b").filter("a < b").distinct(), "near-pairs")
    few = saved(texts.join(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "doc_id", "left_semi"), "near-texts")
    a, b = (few.select(F.col("doc_id").alias(k), F.col("text").alias(t)) for k, t in (("a", "s"), ("b", "t")))
    links = saved(pairs.join(a, "a").join(b, "b").select("a", "b", "s", "t").mapInArrow(_alike(similarity), "a long, b long"), "near-links")
    large = placed.filter("deep").select("bucket").distinct()
    if large.isEmpty():
        return links
    members = placed.join(large, "bucket").select("bucket", F.explode(F.array("b", F.col("met")[0])).alias("id")).distinct()
    roots = components(links).select(F.col("node").alias("id"), "root").distinct()
    rooted = saved(members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "near-members")
    payload = few.select(F.col("doc_id").alias("id"), "text")
    return links.unionByName(squares.meet(rooted, payload, "4096 + length(text)", SQUARE_BYTES, _alike_squares(similarity), "a long, b long"))


def drop_near_copies(docs: DataFrame, radius: int = WORD_SET_RADIUS) -> DataFrame:
    """``docs`` with one document of each group of near copies, linked by five-word Jaccard similarity: the smallest
    doc_id. Links are verified pairs; groups are what they connect.

    Rows whose id is null stay, and so do texts without words, which are no copies of each other's content. A text
    whose only words are punctuation counts them as words. Rows of one id stay or go together. Texts are compared whole,
    however long. Other columns, whatever their names, come through unchanged; an empty table stays empty.
    """
    found = components(near_copy_links(docs.filter(F.col("text").rlike("[^ \\t-\\r]")), radius))
    (gone,) = fresh(docs, "gone_id")
    drop = found.filter("node > root").select(F.col("node").alias(gone)).distinct()
    return docs.join(drop, F.col("doc_id").cast("long") == F.col(gone), "left_anti")
