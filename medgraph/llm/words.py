"""Texts as numbers of words, and tables of the words that they hold.

The scan splits texts once. It packs whole documents into blocks of up to BLOCK_BYTES of text and numbers each block's
distinct words, the most frequent first, so a block is its documents' word numbers and one list of words. Everything else is
rows: ``word_rows`` gives one (word, block, number) row for each distinct word of a block, which an ordinary shuffle by
word brings together over the corpus, and what is found there goes back by (block, number). So rows follow the input,
and a word that stands in every line costs one row for each block.

Answers for a block leave a task packed, all numbers that the task holds for it in one row (value arrays beside the
numbers), so the way back is never more than a row for each word and mostly far less.
"""

from __future__ import annotations

import itertools
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .blocks import squeeze, unsqueeze
from .shared import clean_docs, text_bytes

#: Most and least text bytes of a block. Between them, every core gets some blocks. A scan task's last block is smaller,
#: and a single longer document makes a longer one.
BLOCK_BYTES, LEAST_BYTES = 32 << 20, 1 << 20
#: Answers that a task holds before it sends them.
PENDING = 1 << 20
_NAMES = ["block", "ids", "sizes", "numbers", "words"]
BLOCK = "block long, " + ", ".join(f"{c} binary" for c in _NAMES[1:])
_BLOCK = pa.schema([("block", pa.int64()), *((c, pa.binary()) for c in _NAMES[1:])])
ANSWER = "block long, kind int, part int, data binary"
#: What came back for a block: kind, part and data of each answer.
Answers = list[tuple[int, int, bytes]]
Split = Callable[[bytes], list[bytes]]


def planes(x: np.ndarray, width: int = 4) -> bytes:
    """Numbers of ``width`` bytes by byte position, which compresses better. A number that is too large is an error."""
    if len(x) and (int(x.min()) < 0 or int(x.max()) >> (8 * width)):
        raise OverflowError(f"a number does not fit {width} bytes")
    whole = 4 if width <= 4 else 8
    return np.ascontiguousarray(x.astype(f"<u{whole}").view(np.uint8).reshape(-1, whole)[:, :width].T).tobytes()


class Reader:
    """Reads what ``planes`` and ``struct`` wrote, in order."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def numbers(self, n: int, width: int = 4) -> np.ndarray:
        whole = 4 if width <= 4 else 8
        found = np.zeros((n, whole), dtype=np.uint8)
        found[:, :width] = np.frombuffer(self.raw, dtype=np.uint8, count=width * n, offset=self.at).reshape(width, n).T
        self.at += width * n
        return found.view(f"<u{whole}").ravel().astype(np.int64)

    def array(self, n: int, dtype: str) -> np.ndarray:
        found = np.frombuffer(self.raw, dtype=dtype, count=n, offset=self.at)
        self.at += found.nbytes
        return found

    def head(self, layout: str) -> tuple:
        found = struct.unpack_from(layout, self.raw, self.at)
        self.at += struct.calcsize(layout)
        return found


class Block:
    """Documents of a block in scan order: ids, words in each, all their word numbers, and the distinct words."""

    def __init__(self, row: dict):
        self.key, self.row = row["block"], row
        self.sizes = np.frombuffer(unsqueeze(row["sizes"]), dtype=np.int64)
        both, n = unsqueeze(row["ids"]), len(self.sizes)
        self.ids, self.null_id = np.frombuffer(both, dtype=np.int64, count=n), np.frombuffer(both, dtype=np.uint8, offset=8 * n).astype(bool)
        self._numbers, self._words = row.get("numbers"), row.get("words")

    @property
    def numbers(self) -> np.ndarray:
        return Reader(unsqueeze(self._numbers)).numbers(int(self.sizes.sum()))

    @property
    def words(self) -> list[bytes]:
        return unsqueeze(self._words).split()

    def id_list(self) -> list[int | None]:
        return [None if gone else i for i, gone in zip(self.ids.tolist(), self.null_id.tolist(), strict=True)]


def _pack(split: Split, block_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n_blocks = TaskContext.get().partitionId(), 0
        ids: list[int | None] = []
        texts: list[np.ndarray] = []
        number: dict[bytes, int] = defaultdict(itertools.count().__next__)
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal ids, texts, number, size, n_blocks
            values = np.array([0 if i is None else i for i in ids], dtype=np.int64)
            gone = np.array([i is None for i in ids], dtype=np.uint8)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            # numbered anew by falling count, equal counts in order of their first bytes: both lists compress better so
            flat, names = np.concatenate(texts), list(number)
            begin = np.array(names, dtype="S8").view(">u8").astype(np.uint64)
            by_count = np.lexsort((begin, -np.bincount(flat, minlength=len(names))))
            now = np.empty(len(names), dtype=np.uint32)
            now[by_count] = np.arange(len(names), dtype=np.uint32)
            made = [values.tobytes() + gone.tobytes(), sizes.tobytes(), planes(now[flat]), b" ".join([names[i] for i in by_count.tolist()])]
            key = xxhash.xxh3_64(struct.pack("<qq", part, n_blocks))
            for x in made:
                key.update(x)
            ids, texts, number, size, n_blocks = [], [], defaultdict(itertools.count().__next__), 0, n_blocks + 1
            return pa.RecordBatch.from_arrays([pa.array([key.intdigest() - (1 << 63)]), *(pa.array([squeeze(x, small=True)], type=pa.binary()) for x in made)], schema=_BLOCK)

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                text = t.as_py() or b""
                ws = split(text)
                ids.append(i)
                texts.append(np.fromiter(map(number.__getitem__, ws), dtype=np.uint32, count=len(ws)))
                size += len(text)
                if size >= block_bytes:
                    yield out()
        if ids:
            yield out()

    return pack


def word_blocks(docs: DataFrame, split: Split, block_bytes: int | None = None) -> DataFrame:
    """Blocks of whole documents, dealt by a key that is a hash of what they hold and where they were cut, so that a
    task that runs again makes the same ones. ``split`` gives a text's words, none of which holds ASCII white space."""
    block_bytes = block_bytes or block_size(docs, text_bytes(docs))
    return clean_docs(docs).mapInArrow(_pack(split, block_bytes), BLOCK).repartition("block")


def block_size(docs: DataFrame, size: int) -> int:
    """Bytes of a block for so many bytes of text: every core gets two blocks, within the limits."""
    return min(BLOCK_BYTES, max(LEAST_BYTES, size // (2 * docs.sparkSession.sparkContext.defaultParallelism)))


def word_rows(blocks: DataFrame, train: Callable[[Block], np.ndarray] | None = None, end: bytes | None = None) -> DataFrame:
    """(word, block, number) of each distinct word of a block; with ``train`` (true for the documents that count) also
    ``n``, how often the word stands in those. ``end``: one more word, numbered last, that stands once in each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                words = block.words if end is None else [*block.words, end]
                columns = [pa.array(words, type=pa.binary()), pa.array(np.full(len(words), block.key)), pa.array(np.arange(len(words), dtype=np.int32))]
                if train is not None:
                    docs = train(block)
                    n = np.bincount(block.numbers[np.repeat(docs, block.sizes)], minlength=len(words)).astype(np.int64)
                    if end is not None:
                        n[-1] = docs.sum()
                    columns.append(pa.array(n))
                table = pa.RecordBatch.from_arrays(columns, names=["word", "block", "number", "n"][: len(columns)])
                for at in range(0, len(words), 1 << 16):
                    yield table.slice(at, 1 << 16)

    # all columns are passed on, for the exchange that holds the blocks to be the same one, and reused
    return blocks.mapInArrow(rows, "word binary, block long, number int" + (", n long" if train is not None else ""))


def by_block(block: np.ndarray, data: Callable[[np.ndarray], bytes], kind: int = 0, part: int = 0) -> pa.RecordBatch:
    """One answer row for each block: ``data`` of the places that belong to it."""
    order = np.argsort(block, kind="stable")
    edges = [0, *(np.flatnonzero(np.diff(block[order])) + 1).tolist(), len(order)]
    parts = [order[a:b] for a, b in itertools.pairwise(edges) if b > a]
    keys, found = [int(block[p[0]]) for p in parts], [squeeze(data(p)) for p in parts]
    columns = [pa.array(keys, type=pa.int64()), pa.array([kind] * len(keys), type=pa.int32()), pa.array([part] * len(keys), type=pa.int32()), pa.array(found, type=pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["block", "kind", "part", "data"])


def meet(blocks: DataFrame, answers: DataFrame, fn: Callable[[Block, Answers], Iterator[pa.Table]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Each block with all its answers, to rows of the result. Answers without a block (totals) are passed over."""

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows and right.column("block")[0].as_py() is None:
            return arrow.empty_table()
        if left.num_rows != 1:
            raise RuntimeError("answers without their block, or two blocks of one key")
        got = [(r["kind"], r["part"], unsqueeze(r["data"])) for r in right.to_pylist()]
        found = list(fn(Block(left.to_pylist()[0]), got))
        return pa.concat_tables([t.cast(arrow) for t in found]) if found else arrow.empty_table()

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)
