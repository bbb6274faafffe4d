"""BPE encoding and decoding through a table of distinct words.

Texts are split into words in Spark; a shuffle by word brings each distinct word of the corpus together, where it is
encoded once; its ids go back to the blocks and take the word's positions. Decoding joins ids to pieces.

A word is a run without ASCII white space. The vocabulary's own splitter never crosses white space, its normaliser
(NFC, then lower case) composes no character with white space, and special tokens hold no white space, so a text's ids
are its words' ids in order.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

#: Words of a block's texts that are turned into ids at a time.
CHUNK = 1 << 18


@lru_cache(maxsize=2)
def tokenizer(vocabulary: str):
    """The public tokenizer of a file, without truncation, padding and threads of its own (Spark's tasks fill the cores)."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> list[str]:
    """Piece of each id. As long as the vocabulary, whatever the corpus."""
    t = tokenizer(vocabulary)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def words(text: bytes) -> list[bytes]:
    """Words of a text. Words wholly in ASCII are lowered first, as the vocabulary does, to have fewer distinct words;
    others keep their case, since a letter and a mark may compose in lower case only. Texts that may spell a special
    token keep theirs too, since those are matched before lowering."""
    if b"<|" in text:
        return text.split()
    if text.isascii():
        return text.lower().split()
    found = text.lower().split()
    cased = [i for i, w in enumerate(found) if not w.isascii()]
    if cased:
        as_is = text.split()
        for i in cased:
            found[i] = as_is[i]
    return found


def _encode(vocabulary: str):
    """Rows sorted by word to packed answers: ids of each (block, number). A run of equal words is encoded once."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(vocabulary)
        last, last_ids = None, []
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def out() -> pa.RecordBatch:
            block, number, lengths = (np.concatenate([h[k] for h in held]) for k in range(3))
            flat, starts = np.concatenate([h[3] for h in held]), np.cumsum(lengths) - lengths

            def data(places: np.ndarray) -> bytes:
                places = places[np.argsort(number[places])]
                n = lengths[places]
                take = np.repeat(starts[places] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                return np.int64(len(places)).tobytes() + W.planes(np.diff(number[places], prepend=0)) + W.planes(n) + W.planes(flat[take])

            return W.by_block(block, data)

        for batch in batches:
            distinct, counts = _runs(batch.column(0))
            same = bool(distinct) and distinct[0] == last
            found = [e.ids for e in t.encode_batch_fast([w.decode() for w in distinct[same:]], add_special_tokens=False)]
            ids = ([last_ids] if same else []) + found
            if not ids:
                continue
            last, last_ids = distinct[-1], ids[-1]
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            once, first = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32), np.cumsum(sizes) - sizes
            lengths = np.repeat(sizes, counts)
            flat = once[np.repeat(np.repeat(first, counts) - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))]
            held.append((batch.column(1).to_numpy(), batch.column(2).to_numpy(), lengths, flat))
            size += batch.num_rows
            if size >= W.PENDING:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return encode


def _runs(column: pa.Array) -> tuple[list[bytes], list[int]]:
    """Distinct values of a sorted column and how often each stands there."""
    runs = pc.run_end_encode(column)
    ends = runs.run_ends.to_numpy()
    return runs.values.to_pylist(), np.diff(ends, prepend=0).tolist()


class WordIds:
    """Ids of a block's words, by number; the number after the last stands for the end of a document."""

    def __init__(self, n_words: int, answers: W.Answers, end: int | None = None):
        parts = []
        for _, _, raw in answers:
            r = W.Reader(raw)
            (n,) = r.head("<q")
            number, lengths = np.cumsum(r.numbers(n)), r.numbers(n)
            parts.append((number, lengths, r.numbers(int(lengths.sum()))))
        self.lengths = np.zeros(n_words + 1, dtype=np.int64)
        starts = np.zeros(n_words + 1, dtype=np.int64)
        at, flat = 0, []
        for number, lengths, ids in parts:
            self.lengths[number] = lengths
            starts[number] = at + np.cumsum(lengths) - lengths
            at += len(ids)
            flat.append(ids.astype(np.uint32))
        if end is not None:
            self.lengths[n_words], starts[n_words] = 1, at
            flat.append(np.array([end], dtype=np.uint32))
        self.starts, self.flat = starts, np.concatenate(flat) if flat else np.zeros(0, dtype=np.uint32)

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        """Ids of words in order."""
        n = self.lengths[numbers]
        return self.flat[np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


def with_word_ids(docs: DataFrame, vocabulary: str, fn: Callable[[W.Block, W.Answers], Iterator[pa.Table]], schema: str, arrow: pa.Schema, block_bytes: int | None = None) -> DataFrame:
    """Rows that ``fn(block, answers with its words' ids)`` makes of each block of documents."""
    base = W.word_blocks(docs, words, block_bytes)
    table = W.word_rows(base).repartition("word").sortWithinPartitions("word").mapInArrow(_encode(vocabulary), W.ANSWER)
    return W.meet(base, table, fn, schema, arrow)


_DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _id_rows(block: W.Block, answers: W.Answers) -> Iterator[pa.RecordBatch]:
    """(doc_id, ids) of a block's documents, whole documents of about CHUNK words at a time."""
    numbers, at, first = block.numbers, 0, 0
    table = WordIds(int(numbers.max(initial=-1)) + 1, answers)
    ids, ends = block.id_list(), np.cumsum(block.sizes)
    while first < len(ids):
        last = max(first + 1, int(np.searchsorted(ends, at + CHUNK, side="right")))
        mine = numbers[at : ends[last - 1]]
        tokens = np.append(0, np.cumsum(table.lengths[mine]))[np.append(0, ends[first:last] - at)]
        lists = pa.ListArray.from_arrays(pa.array(tokens.astype(np.int32)), pa.array(table.ids(mine).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[first:last], type=pa.int64()), lists], names=["doc_id", "ids"])
        first, at = last, int(ends[last - 1])


def encode(docs: DataFrame, vocabulary: str, block_bytes: int | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text. Null and empty texts have no ids; repeated rows give repeated rows; an
    empty table gives none."""

    def rows(block: W.Block, answers: W.Answers) -> Iterator[pa.Table]:
        yield pa.Table.from_batches(list(_id_rows(block, answers)))

    return with_word_ids(docs, vocabulary, rows, "doc_id long, ids array<int>", _IDS, block_bytes)


def _at_ids(ids: pa.ListArray, table: pa.StringArray) -> pa.StringArray:
    """Each row's ids joined to the table's strings, with blanks between."""
    lists = pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), pc.take(table, ids.flatten()))
    return pc.binary_join(lists, " ")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text): every id joined to the piece table. The vocabulary names no decoder: pieces stand with
    blanks between. ``encoded`` needs ``doc_id`` and ``ids``; rows without ids give the empty text.

    The piece table has a row for every id from 0 on, so the join's key is the row's number: each id looks its piece
    up, in Arrow batches, and no row per id is shuffled and sorted back into its text. It is as long as the vocabulary.
    """

    filled = encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return filled.mapInArrow(lambda batches: _decoded(batches, vocabulary), "doc_id long, ids array<int>, text string")


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    table = pa.array(pieces(vocabulary))
    for batch in _slices(batches):
        yield pa.RecordBatch.from_arrays([*batch.columns, _at_ids(batch.column(1), table)], names=["doc_id", "ids", "text"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def token_digests(docs: DataFrame, vocabulary: str, block_bytes: int | None = None) -> DataFrame:
    """Per document: token count, SHA-256 of its decimal ids and of the decoded text.

    Null or empty text: no tokens, both digests of the empty string. Very long texts are one row like any other;
    repeated rows give repeated results; an empty table gives none.
    """

    def rows(block: W.Block, answers: W.Answers) -> Iterator[pa.Table]:
        decimal = pa.array([str(i) for i in range(len(pieces(vocabulary)))])
        for batch in _decoded(_id_rows(block, answers), vocabulary):  # a part of the block is decoded when it is encoded
            digests = [pa.array([hashlib.sha256(x).hexdigest() for x in column.cast(pa.binary()).to_pylist()], type=pa.string()) for column in (_at_ids(batch.column(1), decimal), batch.column(2))]
            yield pa.table([batch.column(0), pc.list_value_length(batch.column(1)).cast(pa.int64()), *digests], names=_DIGESTS.names)

    return with_word_ids(docs, vocabulary, rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _DIGESTS, block_bytes)
