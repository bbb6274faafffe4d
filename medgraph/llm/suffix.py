"""Suffix-array dedup by blockwise, difference-cover construction.

A byte goes when a 50-byte string over it also starts in a document with a smaller id. Only suffixes that can repeat
are sorted. A window of 50 bytes is filed under its anchor, the 24-byte string in it with the least hash (leftmost of
equals), which every copy of the window shares; a first ask-and-answer round finds the anchors that more than one
document holds. The suffixes under those anchors then go to the anchors' buckets. A bucket is sorted by itself: ties
that run past the first bytes are resolved by ranks of a difference-cover sample of its suffixes, computed beforehand,
so no comparison runs the length of a tie and memory is bounded by a bucket. Neighbours in sorted order that agree on
50 bytes are copies; the least document id among them decides, and one bit per suffix goes back.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .shared import clean_docs, fresh, text_bytes

LENGTH = 50
#: Bytes of an anchor; a window of LENGTH bytes holds GRAMS of them.
GRAM = 24
GRAMS = LENGTH - GRAM + 1
#: Difference cover modulo 7: any two residues meet it after the same number of steps.
PERIOD, COVER = 7, (0, 1, 3)
STEPS = [next(d for d in range(PERIOD) if (c + d) % PERIOD in COVER) for c in range(PERIOD)]
REST = max(STEPS)
WIDTH = GRAMS - 1 + LENGTH
#: Suffix groups sorted at a time, and bytes scanned at a time.
BUCKET_ROWS = 1 << 16
CHUNK = 1 << 19
ANCHORS, VERDICTS = 1, 2
NO_ID = np.iinfo(np.int64).max

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0xBF58476D1CE4E5B9)]


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX[0]
    size, grams = 1, {1: h}
    while 2 * size <= GRAM:
        h = h[: len(h) - size] * _MIX[1 + size.bit_length() % 4] + h[size:]
        size *= 2
        grams[size] = h
    need, at, out = GRAM, 0, None
    n = len(data) - GRAM + 1
    for part in sorted(grams, reverse=True):
        if need >= part:
            piece = grams[part][at : at + n]
            out = piece if out is None else out * _MIX[4] + piece
            at, need = at + part, need - part
    out = (out ^ (out >> np.uint64(31))) * _MIX[5]
    return out ^ (out >> np.uint64(29))


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    size, m = 1, h
    while 2 * size <= width:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    return np.minimum(m[: len(h) - width + 1], m[width - size : width - size + len(h) - width + 1]) if size < width else m


def _runs(data: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows under one anchor: first and last start, anchor position, anchor hash. ``doc``: of each byte."""
    parts = []
    for begin in range(0, len(data) - LENGTH + 1, CHUNK):
        end = min(len(data), begin + CHUNK + LENGTH - 1)
        h = _gram_hashes(data[begin:end])
        least = _sliding_min(h, GRAMS)
        n = len(least)
        valid = doc[begin : begin + n] == doc[begin + LENGTH - 1 : begin + LENGTH - 1 + n]
        new = np.ones(n, dtype=bool)  # a run ends when the least hash changes, its anchor falls out, or a text ends
        new[1:] = (least[1:] != least[:-1]) | (h[: n - 1] == least[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        keep = valid[first]
        first, last = first[keep], last[keep]
        value = least[first]
        anchor = first + GRAMS - 1
        search = np.flatnonzero((h[anchor] != value) | ~_alone(h, first, value))
        anchor[search] = first[search] + (h[first[search][:, None] + np.arange(GRAMS)] == value[search][:, None]).argmax(axis=1)
        parts.append((first + begin, last + begin, anchor + begin, value))
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _alone(h: np.ndarray, first: np.ndarray, value: np.ndarray) -> np.ndarray:
    """True where the window before had a larger least hash, so that the last gram is the only one of its value."""
    before = np.maximum(first - 1, 0)
    inner = _sliding_min(h, GRAMS - 1)
    return (first > 0) & (inner[np.minimum(first, len(inner) - 1)] > value) & (before < first)


class Scan:
    """A block's runs, its distinct anchors in the owners' order, and who holds each."""

    def __init__(self, block: B.Block, shards: int):
        self.block, self.data = block, np.frombuffer(block.data, dtype=np.uint8)
        self.ids = np.where(block.null_id, NO_ID, block.ids)
        self.doc = np.repeat(np.arange(len(block.sizes)), block.sizes)
        self.first, self.last, self.anchor, self.value = _runs(self.data, self.doc)
        self.owner = ((self.value >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)
        self.run_id = self.ids[self.doc[self.first]] if len(self.first) else np.zeros(0, dtype=np.int64)
        order = np.lexsort((self.value, self.owner))
        v = self.value[order]
        head = np.ones(len(v), dtype=bool)
        head[1:] = v[1:] != v[:-1]
        starts = np.flatnonzero(head)
        ids = self.run_id[order]
        self.distinct, self.distinct_owner = v[starts], self.owner[order][starts]
        self.several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(starts) else np.zeros(0, dtype=bool)
        self.number = np.empty(len(v), dtype=np.int64)
        self.number[order] = np.cumsum(head) - 1

    def by_owner(self) -> list[tuple[int, slice]]:
        cuts = np.flatnonzero(np.diff(self.distinct_owner)) + 1
        edges = [0, *cuts.tolist(), len(self.distinct_owner)]
        return [(int(self.distinct_owner[a]), slice(a, b)) for a, b in zip(edges, edges[1:], strict=False) if b > a]

    def anchors(self) -> list[tuple[int, bytes]]:
        return [(s, np.diff(self.distinct[at], prepend=np.uint64(0)).tobytes() + np.packbits(self.several[at]).tobytes()) for s, at in self.by_owner()]

    def candidates(self, got: dict[int, bytes]) -> None:
        """Keep runs of anchors that several documents hold, and number their distinct strings by owner."""
        shared = np.zeros(len(self.distinct), dtype=bool)
        for s, at in self.by_owner():
            n = at.stop - at.start
            shared[at] = np.unpackbits(np.frombuffer(got[s], dtype=np.uint8), count=n).astype(bool)
        keep = np.flatnonzero(shared[self.number]) if len(self.number) else np.zeros(0, dtype=np.int64)
        keep = keep[np.lexsort((keep, self.value[keep], self.owner[keep]))]
        self.first, self.last, self.anchor, self.value, self.owner, self.run_id = (x[keep] for x in (self.first, self.last, self.anchor, self.value, self.owner, self.run_id))
        seen: dict[tuple[bytes, int], int] = {}
        data = self.block.data
        self.string = np.fromiter((seen.setdefault((data[a:b], c), len(seen)) for a, b, c in zip(self.first.tolist(), (self.last + LENGTH).tolist(), (self.anchor - self.first).tolist(), strict=True)), dtype=np.int64, count=len(keep))
        self.strings = list(seen)
        at = np.unique(self.string, return_index=True)[1]  # strings are numbered as they appear, so by owner
        self.string_owner, self.string_value = self.owner[at], self.value[at]
        self.string_id = np.full(len(at), NO_ID)
        np.minimum.at(self.string_id, self.string, self.run_id)

    def strings_by_owner(self) -> list[tuple[int, slice]]:
        cuts = np.flatnonzero(np.diff(self.string_owner)) + 1
        edges = [0, *cuts.tolist(), len(self.string_owner)]
        return [(int(self.string_owner[a]), slice(a, b)) for a, b in zip(edges, edges[1:], strict=False) if b > a]

    def suffixes(self) -> list[tuple[int, bytes]]:
        out = []
        for s, at in self.strings_by_owner():
            mine = self.strings[at]
            sizes = np.array([[len(x), back] for x, back in mine], dtype=np.uint8)
            head = np.int64(len(mine)).tobytes() + self.string_value[at].tobytes() + self.string_id[at].tobytes()
            out.append((s, head + sizes.T.tobytes() + b"".join(x for x, _ in mine)))
        return out

    def removed(self, got: dict[int, bytes]) -> np.ndarray:
        """True for each byte that goes."""
        bits = np.zeros(len(self.strings), dtype=np.uint32)
        for s, at in self.strings_by_owner():
            bits[at] = np.frombuffer(got[s], dtype=np.uint32)
        edge = np.zeros(len(self.data) + 1, dtype=np.int64)
        whole = self.run_id > self.string_id[self.string] if len(self.string) else np.zeros(0, dtype=bool)
        np.add.at(edge, self.first[whole], 1)
        np.add.at(edge, self.last[whole] + LENGTH, -1)
        first, mine = self.first[~whole], bits[self.string[~whole]]
        for t in range(GRAMS):
            start = first[(mine >> np.uint32(t)) & np.uint32(1) == 1] + t
            np.add.at(edge, start, 1)
            np.add.at(edge, start + LENGTH, -1)
        return np.cumsum(edge[:-1]) > 0


def _shared_anchors(requests: list[bytes]):
    """Bits of each request's anchors: held by several documents."""
    values, several = [], []
    for r in requests:
        n = (8 * len(r)) // 65  # 8 bytes and a bit for each
        values.append(np.cumsum(np.frombuffer(r, dtype=np.uint64, count=n)))
        several.append(np.unpackbits(np.frombuffer(r, dtype=np.uint8, offset=8 * n), count=n).astype(bool))
    every = np.concatenate(values)
    distinct, number, count = np.unique(every, return_inverse=True, return_counts=True)
    hit = count > 1
    hit[number[np.concatenate(several)]] = True
    at = 0
    for v in values:
        yield np.packbits(hit[number[at : at + len(v)]]).tobytes()
        at += len(v)


def _ranks(rows: np.ndarray) -> dict[int, np.ndarray]:
    """Dense rank of LENGTH - REST bytes from each column of the difference-cover sample."""
    out = {}
    for c in range(GRAMS):
        at = c + STEPS[c % PERIOD]
        if at not in out:
            text = np.ascontiguousarray(rows[:, at : at + LENGTH - REST]).view(f"S{LENGTH - REST}").ravel()
            out[at] = np.unique(text, return_inverse=True)[1].astype(np.int64)
    return out


def _sort_bucket(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Bits by column: the suffix from there occurs in a document with a smaller id than the row's.

    A suffix's key is its cover-sample rank with the bytes that stand before and after the ranked ones.
    """
    ranks, bits = _ranks(rows), np.zeros(len(rows), dtype=np.uint64)
    for c in range(GRAMS):
        mine = np.flatnonzero((lo <= c) & (c <= hi))
        if not len(mine):
            continue
        step = STEPS[c % PERIOD]
        key = ranks[c + step][mine]
        for x in [*range(c, c + step), *range(c + step + LENGTH - REST, c + LENGTH)]:
            key = key << 8 | rows[mine, x]
        order = np.argsort(key, kind="stable")
        head = np.ones(len(mine), dtype=bool)
        head[1:] = key[order][1:] != key[order][:-1]
        starts = np.flatnonzero(head)
        least = np.minimum.reduceat(ids[mine][order], starts)[np.cumsum(head) - 1]
        hit = mine[order[least < ids[mine][order]]]
        bits[hit] |= np.uint64(1) << np.uint64(c)
    return bits


def _verdicts(requests: list[bytes]):
    values, ids, sizes, backs, texts, counts = [], [], [], [], [], []
    for r in requests:
        n = int(np.frombuffer(r, dtype=np.int64, count=1)[0])
        counts.append(n)
        values.append(np.frombuffer(r, dtype=np.uint64, count=n, offset=8))
        ids.append(np.frombuffer(r, dtype=np.int64, count=n, offset=8 + 8 * n))
        both = np.frombuffer(r, dtype=np.uint8, count=2 * n, offset=8 + 16 * n)
        sizes.append(both[:n].astype(np.int64))
        backs.append(both[n:].astype(np.int64))
        texts.append(np.frombuffer(r, dtype=np.uint8, offset=8 + 18 * n))
    value, id_, size, back, text = (np.concatenate(x) for x in (values, ids, sizes, backs, texts))
    begin = np.cumsum(size) - size
    order = np.argsort(value, kind="stable")
    out = np.zeros(len(value), dtype=np.uint32)
    ends = np.append(np.flatnonzero(np.diff(value[order])) + 1, len(order))  # of suffix groups that share an anchor
    at = 0
    while at < len(order):
        end = int(ends[min(len(ends) - 1, np.searchsorted(ends, at + BUCKET_ROWS))])
        take = order[at:end]
        rows = np.zeros((len(take), WIDTH), dtype=np.uint8)
        n, lo = size[take], GRAMS - 1 - back[take]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        rows[np.repeat(np.arange(len(take)), n), np.repeat(lo, n) + inner] = text[np.repeat(begin[take], n) + inner]
        bits = _sort_bucket(rows, lo, lo + n - LENGTH, id_[take])
        out[take] = (bits >> lo.astype(np.uint64)).astype(np.uint32)
        at = end
    at = 0
    for n in counts:
        yield out[at : at + n].tobytes()
        at += n


def _repeats(docs: DataFrame, fn, schema: str, block_bytes: int) -> DataFrame:
    """Rows that ``fn(block, text, removed bytes, kept bytes)`` makes of each document."""
    shards = B.n_shards(text_bytes(clean_docs(docs)))
    base = B.pack(docs, block_bytes)
    anchors = B.answer(B.ask(base, lambda block, _: Scan(block, shards).anchors()), ANCHORS, _shared_anchors)

    def suffixes(block: B.Block, got: B.Answers):
        scan = Scan(block, shards)
        scan.candidates(got.get(ANCHORS, {}))
        return scan.suffixes()

    verdicts = B.answer(B.ask(base, suffixes, anchors), VERDICTS, _verdicts)

    def rows(block: B.Block, got: B.Answers) -> pd.DataFrame:
        scan = Scan(block, shards)
        scan.candidates(got.get(ANCHORS, {}))
        gone = scan.removed(got.get(VERDICTS, {}))
        out, at = [], 0
        for doc_id, n in zip(block.id_list(), block.sizes.tolist(), strict=True):
            mine, text = gone[at : at + n], block.data[at : at + n]
            kept = scan.data[at : at + n][~mine].tobytes() if mine.any() else text
            out.append(fn(doc_id, text, mine, kept))
            at += n
        pdf = pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])
        pdf["doc_id"] = pdf["doc_id"].astype("Int64")
        return pdf

    return B.finish(base, anchors.unionByName(verdicts), rows, schema)


def repeat_digests(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a 50-byte string over it also starts in a document with a smaller id, judged on the input. Null
    texts are empty; texts under 50 bytes stay. A row without an id counts as larger than any id, and two rows of the
    same id (or both without) never remove each other's bytes. An empty table gives no rows.
    """

    def digest(doc_id, text, gone, kept):
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        return doc_id, len(text), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest()

    return _repeats(docs, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", block_bytes)


def remove_repeats(docs: DataFrame, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """``docs`` with repeated bytes cut out of ``text`` (and ``n_chars``, if there, counted anew). Characters of which
    a byte went are dropped whole. Texts without a repeat stay as they are, null included. Rows that repeat both id and
    text are cut alike. Other columns, whatever their names, come through unchanged; an empty table stays empty.
    """

    def cut(doc_id, text, gone, kept):
        return doc_id, hashlib.sha256(text).hexdigest(), kept.decode(errors="ignore"), len(kept) != len(text)

    # texts come from the blocks; the table's other columns join them by id and hash, and no text is shuffled twice
    i, sha, kept, was_cut, row_sha, null = fresh(docs, "id_of_row", "sha_of_text", "kept_text", "was_cut", "sha_of_row", "no_text")
    texts = _repeats(docs, cut, "doc_id long, sha string, kept string, was_cut boolean", block_bytes).toDF(i, sha, kept, was_cut).dropDuplicates([i, sha])
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    rest = docs.withColumn(row_sha, digest).withColumn(null, F.col("text").isNull()).drop("text")
    joined = rest.join(texts, (F.col("doc_id").cast("long").eqNullSafe(F.col(i))) & (F.col(row_sha) == F.col(sha)))
    text = F.when(~F.col(null), F.col(kept))
    count = lambda c: F.when(F.col(was_cut), F.length(kept).cast("long")).otherwise(F.col(c)).alias(c)
    return joined.select(*[text.alias(c) if c == "text" else count(c) if c == "n_chars" else F.col(c) for c in docs.columns])
