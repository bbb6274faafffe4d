"""Ask-and-answer over blocks of documents.

Several operators need one figure from the whole corpus for every word (or n-gram, or byte string) of every text. A
join on each occurrence would shuffle many times the corpus. Here the scan packs whole documents into blocks of a few
MB (one compressed row each); a block *asks* once for each distinct thing it holds, the request goes to the shard that
owns the thing, the shard *answers* with one value for each, and the answers meet the block again in a cogroup on the
block's key. Spark deals, shuffles and retries all of it; a hot word costs one request per block, not one per
occurrence. The exchange that holds the blocks is the same subplan at each use, so Spark reuses its files.

A request row is (shard, block, data) and an answer row (block, shard, kind, data). ``data`` is compressed.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_docs

BLOCK = "block long, ids binary, sizes binary, data binary, n_bytes long"
REQUEST = "shard int, block long, data binary"
ANSWER = "block long, shard int, kind int, data binary"
#: Text bytes of a block. Bounds a task's Python memory; only a single longer document makes a longer block.
BLOCK_BYTES = 4 << 20
#: Text bytes for each shard that answers.
SHARD_BYTES = 24 << 20

_ZSTD = pa.Codec("zstd", compression_level=1)
_ZSTD_SMALL = pa.Codec("zstd", compression_level=3)


def squeeze(data: bytes, small: bool = False) -> bytes:
    return struct.pack("<q", len(data)) + (_ZSTD_SMALL if small else _ZSTD).compress(data, asbytes=True)


def unsqueeze(data: bytes) -> bytes:
    (n,) = struct.unpack_from("<q", data)
    return _ZSTD.decompress(data[8:], decompressed_size=n, asbytes=True)


@dataclass
class Block:
    """Documents of a block in scan order; ``null_id`` marks rows whose doc_id is null (their id reads 0)."""

    key: int
    ids: np.ndarray
    null_id: np.ndarray
    sizes: np.ndarray
    data: bytes

    def texts(self) -> Iterator[bytes]:
        """UTF-8 bytes of each text; a null text is empty."""
        at = 0
        for n in self.sizes.tolist():
            yield self.data[at : at + n]
            at += n

    def id_list(self) -> list[int | None]:
        return [None if gone else i for i, gone in zip(self.ids.tolist(), self.null_id.tolist(), strict=True)]


def _pack(block_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        ids: list[int | None] = []
        texts: list[bytes] = []
        size = n_blocks = 0

        def out() -> pa.RecordBatch:
            nonlocal ids, texts, size, n_blocks
            values = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            gone = np.array([i is None for i in ids], dtype=np.uint8)
            sizes, data = np.array([len(t) for t in texts], dtype=np.int64), b"".join(texts)
            digest = xxhash.xxh3_64(struct.pack("<qq", part, n_blocks))
            for x in (values.tobytes(), gone.tobytes(), sizes.tobytes(), data):
                digest.update(x)
            row = {"block": [digest.intdigest() - (1 << 63)], "ids": [squeeze(values.tobytes() + gone.tobytes())], "sizes": [squeeze(sizes.tobytes())], "data": [squeeze(data)], "n_bytes": [len(data)]}
            ids, texts, size, n_blocks = [], [], 0, n_blocks + 1
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("n_bytes", pa.int64())]))

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
                if size >= block_bytes:
                    yield out()
        if ids:
            yield out()

    return pack


def pack(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of whole documents, dealt by their key. The key is a hash of what the block holds and where it was cut."""
    return clean_docs(docs).mapInArrow(_pack(block_bytes), BLOCK).repartition("block")


def _block(row: pd.Series) -> Block:
    raw = np.frombuffer(unsqueeze(row["sizes"]), dtype=np.int64)
    both = unsqueeze(row["ids"])
    n = len(raw)
    return Block(int(row["block"]), np.frombuffer(both, dtype=np.int64, count=n), np.frombuffer(both, dtype=np.uint8, offset=8 * n).astype(bool), raw, unsqueeze(row["data"]))


Answers = dict[int, dict[int, bytes]]


def _whole(left: pd.DataFrame, right: pd.DataFrame) -> tuple[Block, Answers] | None:
    """The block and its answers by kind and shard."""
    if not len(left):
        raise RuntimeError("answers without their block: the scan was cut into other blocks on a retry")
    if len(left) > 1:
        raise RuntimeError("two blocks share a key")
    got: Answers = {}
    for shard, kind, data in zip(right["shard"], right["kind"], right["data"], strict=True):
        got.setdefault(int(kind), {})[int(shard)] = unsqueeze(data)
    return _block(left.iloc[0]), got


def ask(blocks: DataFrame, fn: Callable[[Block, Answers], Iterable[tuple[int, bytes]]], answers: DataFrame | None = None) -> DataFrame:
    """Requests of each block: ``fn`` gives (shard, data), with earlier answers at hand."""

    def rows(block: Block, got: Answers) -> pd.DataFrame:
        found = [(s, block.key, squeeze(d)) for s, d in fn(block, got)]
        return pd.DataFrame(found, columns=["shard", "block", "data"])

    if answers is None:

        def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    yield rows(_block(row), {})

        return blocks.mapInPandas(alone, REQUEST)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda a, b: rows(*_whole(a, b)), REQUEST)


def answer(requests: DataFrame, kind: int, fn: Callable[[list[bytes]], Iterable[bytes]]) -> DataFrame:
    """Each shard sees its requests of all blocks together, sorted by block, and answers each one."""

    def group(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", kind="stable")
        found = list(fn([unsqueeze(x) for x in pdf["data"]]))
        return pd.DataFrame({"block": pdf["block"].to_numpy(), "shard": pdf["shard"].to_numpy(), "kind": kind, "data": [squeeze(x) for x in found]})

    return requests.groupBy("shard").applyInPandas(group, ANSWER)


def finish(blocks: DataFrame, answers: DataFrame, fn: Callable[[Block, Answers], pd.DataFrame], schema: str) -> DataFrame:
    """Each block with all its answers, to rows of the result."""
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(lambda a, b: fn(*_whole(a, b)), schema)


def n_shards(total_bytes: int, shard_bytes: int = SHARD_BYTES) -> int:
    return max(8, -(-total_bytes // shard_bytes))
