"""Bounded-space online packing.

Each group of documents keeps a fixed number of open windows. A piece goes where it leaves least room (best fit). When
it fits in none, the fullest window is emitted: as it is if it lacks only a few tokens, else filled to the brim with
the front of the document. Windows that are still open at the end are leftovers; they are packed again,
many groups at a time, in rounds until one group holds them all.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import numbered, saved
from .tokens import WordIds, with_word_ids

WINDOW = 2048
#: Open windows of a group.
OPEN = 8
#: A window that lacks at most so many tokens is emitted with padding; one that lacks more is filled by cutting.
SLACK = 8
#: Groups whose leftovers are merged at a time.
FAN_IN = 32
END_ID = 1

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, group_id long, window long, offset long, full boolean"
_COLUMNS = [x.split()[0] for x in PIECE.split(", ")]
_ARROW = pa.schema([(c, pa.bool_() if c == "full" else pa.int64()) for c in _COLUMNS])


class OpenWindows:
    """The open windows of one group, and the pieces placed so far."""

    def __init__(self, size: int = WINDOW, n_open: int = OPEN, slack: int = SLACK):
        self.size, self.n_open, self.slack = size, n_open, slack
        self.used: dict[int, int] = {}
        self.n = 0
        self.full: set[int] = set()

    def _place(self, w: int, length: int) -> tuple[int, int]:
        at = self.used[w]
        self.used[w] = at + length
        if self.used[w] == self.size:
            self._emit(w)
        return w, at

    def _emit(self, w: int) -> None:
        del self.used[w]
        self.full.add(w)

    def _new(self) -> int:
        self.used[self.n] = 0
        self.n += 1
        return self.n - 1

    def put(self, length: int, may_cut: bool = True):
        """Yield (window, offset, front, length) for the pieces that ``length`` tokens are cut into."""
        front = 0
        while length - front >= self.size and may_cut:  # a whole window of its own
            w = self._new()
            yield (*self._place(w, self.size), front, self.size)
            front += self.size
        while (left := length - front) > 0:
            fits = [(self.size - u, w) for w, u in self.used.items() if self.size - u >= left]
            if fits:
                yield (*self._place(min(fits)[1], left), front, left)
                return
            if len(self.used) < self.n_open:
                yield (*self._place(self._new(), left), front, left)
                return
            fullest = max(self.used, key=lambda w: (self.used[w], -w))
            room = self.size - self.used[fullest]
            if room > self.slack and may_cut:
                yield (*self._place(fullest, room), front, room)
                front += room
            else:
                self._emit(fullest)


def _merge(size: int, n_open: int):
    """Leftover windows of several groups, packed again without cutting."""

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_id", "window", "offset"], kind="stable")
        keys = pdf["group_id"].astype(str) + "/" + pdf["window"].astype(str)
        order = keys.map(pdf.groupby(keys)["length"].sum())
        pdf = pdf.assign(_total=order, _key=keys).sort_values(["_total", "group_id", "window", "offset"], ascending=[False, True, True, True], kind="stable")
        packer, out = OpenWindows(size, n_open, 0), []
        for _, piece in pdf.groupby("_key", sort=False):
            total = int(piece["length"].sum())
            ((w, at, _, _),) = packer.put(total, may_cut=False)
            out.append(piece.assign(window=w, offset=piece["offset"] + at))
        new = pd.concat(out)
        return new.assign(group_id=int(pdf["next_group"].iloc[0]), full=new["window"].isin(packer.full))[_COLUMNS]

    return merge


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, n_open: int = OPEN, slack: int = SLACK, block_bytes: int | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document ends with id 1, so null and empty texts are one piece of one token. A text longer than a window
    is cut into whole windows and a rest. Repeated rows are packed as often as they stand. An empty table gives none.
    """

    def rows(block: W.Block, answers: W.Answers) -> Iterator[pa.Table]:
        packer, out = OpenWindows(window, n_open, slack), []
        numbers, at = block.numbers, 0
        n_words = int(numbers.max(initial=-1)) + 1
        table = WordIds(n_words, answers, END_ID)
        for doc_id, size in zip(block.id_list(), block.sizes.tolist(), strict=True):
            raw = memoryview(table.ids(np.append(numbers[at : at + size], n_words)).astype("<u4").tobytes())
            at, n = at + size, len(raw) // 4
            out += [(doc_id, front, length, zlib.crc32(raw[4 * front : 4 * (front + length)]), n, block.key, w, offset) for w, offset, front, length in packer.put(n)]
        columns = [pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)]
        full = pa.array([w in packer.full for w in columns[6].to_pylist()])
        yield pa.table([*columns, full], names=_COLUMNS)

    return _merged(with_word_ids(docs, vocabulary, rows, PIECE, _ARROW, block_bytes), window)


def _merged(pieces: DataFrame, window: int) -> DataFrame:
    """Merge leftovers in rounds. A round divides the groups by FAN_IN, so 10 rounds are enough for any table; how many
    are needed follows from the number of groups, which is counted once over the written pieces."""
    pieces = saved(pieces, "pieces")
    groups = pieces.filter(~F.col("full")).select("group_id").distinct().count()
    done, open_ = pieces.filter("full").withColumn("level", F.lit(0)), pieces.filter(~F.col("full"))
    level = 0
    while groups > 1:
        level, groups = level + 1, -(-groups // FAN_IN)
        dealt = open_.withColumn("next_group", F.pmod(F.xxhash64("group_id", F.lit(level)), F.lit(groups)))
        merged = saved(dealt.groupBy("next_group").applyInPandas(_merge(window, 4 * OPEN), PIECE), "leftovers")
        done = done.unionByName(merged.filter("full").withColumn("level", F.lit(level)))
        open_ = merged.filter(~F.col("full"))
    placed = done.unionByName(open_.withColumn("level", F.lit(level)))
    numbers = numbered(placed.select("level", "group_id").distinct(), ["level", "group_id"], "number")
    return placed.join(numbers, ["level", "group_id"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.shiftleft("number", 24) + F.col("window")).alias("sequence_id"), "offset")


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Sequences, tokens and padding of a packing: a sequence is padded to the window, or not at all at a power of two."""
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    even = F.bit_count("n") == 1
    return lengths.agg(F.count("*").alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(even, 0).otherwise(window - F.col("n"))).alias("padding"))
