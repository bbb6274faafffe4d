"""Phrase collocations by an FM-index of word ids for each shard of the corpus.

The scan cuts texts into pieces and pieces into words, and packs them into shards. A shard's index holds two
Burrows-Wheeler transforms over its frequent words, one of its text and one of the text read backwards, both sorted by
as many words as a phrase may have. A phrase is a pair of intervals, one in each order: a word is put behind it by a
step in the backward order, and before it by a step in the forward order. A longer phrase therefore comes from two
parents, the one without its last word and the one without its first, and a level of phrases is extended only where
both are frequent in the whole corpus. Shards send what they count by ranges of phrases, packed; the owner of a range
sums over shards, and tells each shard which of its phrases are frequent. So nothing that reaches the least count is
lost, and every phrase knows the counts of all its first and last parts.
"""

from __future__ import annotations

import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import squeeze, unsqueeze
from .shared import saved, shared_dir
from .words import Reader, planes

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
#: Text bytes of a shard. A longer text goes over several, cut between pieces; only a longer piece makes a longer shard.
SHARD_BYTES = 24 << 20
#: Bits of a shard's key that count the shards of one scan task, and bits of a word's number in its shard.
_SHARD_BITS, _NUMBER_BITS = 12, 31
#: Bytes of a symbol in a stored transform.
_WIDTH = 3
#: Stands between pieces. No UTF-8 text holds this byte.
_EDGE = b"\xff"
_FOLD = bytes(255 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))

_SHARD = pa.schema([("shard", pa.int64()), ("sequence", pa.binary()), ("langs", pa.list_(pa.string())), ("lang_words", pa.list_(pa.int64())), ("books", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])
SHARD = "shard long, sequence binary, langs array<string>, lang_words array<long>, books binary, words binary, counts binary"
INDEX = "shard long, ids binary, forward binary, backward binary"
_INDEX = pa.schema([("shard", pa.int64()), ("ids", pa.binary()), ("forward", pa.binary()), ("backward", pa.binary())])
#: Words of the corpus for each range of phrases that one task sums up.
RANGE_WORDS = 4 << 20
#: What a shard counts in one range of phrases.
COUNTED = "part int, shard long, data binary"
_COUNTED = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("data", pa.binary())])
#: A frequent phrase (its parents' ids, its count, its id; no shard), or which phrases of a shard are frequent.
SETTLED = "prefix long, suffix long, a long, id long, shard long, level int, data binary"
_SETTLED = pa.schema([*((c, pa.int64()) for c in ("prefix", "suffix", "a", "id", "shard")), ("level", pa.int32()), ("data", pa.binary())])


def _runs(text: bytes) -> Iterator[bytes]:
    """A folded text in parts of at most a shard, cut between pieces where it can be."""
    at = 0
    while len(text) - at > SHARD_BYTES:
        cut = text.rfind(_EDGE, at + 1, at + SHARD_BYTES)
        cut = cut if cut > 0 else text.find(_EDGE, at + SHARD_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << _SHARD_BITS
    shard = first
    counter = itertools.count(1)
    books: dict[str, dict[bytes, int]] = {}
    parts: list[np.ndarray] = []
    size = 0

    def out() -> pa.RecordBatch:
        nonlocal counter, books, parts, size, shard
        if shard - first >> _SHARD_BITS:
            raise OverflowError("a scan task holds more shards than their keys can tell apart")
        sequence, langs = np.concatenate(parts), list(books)
        total = sum(len(b) - 1 for b in books.values())
        words, owner = [b""] * total, np.zeros(total, dtype=np.uint16)
        for at, book in enumerate(books.values()):
            for word, number in book.items():
                if number:
                    words[number - 1], owner[number - 1] = word, at
        counts = np.bincount(sequence, minlength=total + 1)[1:].astype(np.int64)
        lang_words = np.bincount(owner, weights=counts, minlength=len(langs)).astype(np.int64)
        row = [[shard], [squeeze(planes(sequence))], [langs], [lang_words.tolist()], [squeeze(owner.tobytes())], [squeeze(b"\n".join(words))], [squeeze(counts.tobytes())]]
        counter, books, parts, size, shard = itertools.count(1), {}, [], 0, shard + 1
        return pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(row, _SHARD, strict=True)], schema=_SHARD)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            for run in _runs((text.as_py() or b"").translate(_FOLD)):
                if lang not in books:
                    books[lang] = defaultdict(counter.__next__, {_EDGE: 0})
                tokens = (_EDGE + run.replace(_EDGE, b" \xff ")).replace(_EDGE, b"\xff ", 1).split()
                parts.append(np.fromiter(map(books[lang].__getitem__, tokens), dtype=np.int32, count=len(tokens)))
                size += len(run)
                if size >= SHARD_BYTES:
                    yield out()
    if parts:
        yield out()


def _word_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, shard, number, n) of each distinct word of a shard."""
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(unsqueeze(row["counts"]), dtype=np.int64)
            if not len(counts):
                continue
            owner = pa.array(np.frombuffer(unsqueeze(row["books"]), dtype=np.uint16).astype(np.int32))
            langs = pa.DictionaryArray.from_arrays(owner, pa.array(row["langs"], type=pa.string())).cast(pa.string())
            columns = [langs, pa.array(unsqueeze(row["words"]).split(b"\n"), type=pa.binary()), pa.array(np.full(len(counts), row["shard"])), pa.array(np.arange(1, len(counts) + 1, dtype=np.int32)), pa.array(counts)]
            table = pa.RecordBatch.from_arrays(columns, names=["lang", "word", "shard", "number", "n"])
            for at in range(0, len(counts), 1 << 16):
                yield table.slice(at, 1 << 16)


def _sorted_places(keys: np.ndarray) -> np.ndarray:
    """Each key (high half) with its place (low half), sorted."""
    both = (keys.astype(np.int64) << 32) | np.arange(len(keys), dtype=np.int64)
    both.sort()
    return both


def _stable(keys: np.ndarray) -> np.ndarray:
    """Places in the order of their keys, equal keys in the order of their places."""
    return _sorted_places(keys) & 0xFFFFFFFF


def transform(x: np.ndarray, depth: int = MAX_WORDS) -> np.ndarray:
    """The symbol before each suffix of the ring ``x``, suffixes in the order of their first ``depth`` symbols."""
    order = np.arange(len(x), dtype=np.int64)
    for j in range(depth - 1, -1, -1):
        order = order[_stable(x[(order + j) % len(x)])]
    return x[order - 1]


def shard_symbols(sequence: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """The shard's text as symbols: 1, 2 ... for the frequent words (``numbers``, ascending), 0 between pieces and for
    all other words. Runs of 0, and words that stand alone between them, go; the ring starts and ends at a 0."""
    symbol = np.zeros(int(sequence.max(initial=0)) + 1, dtype=np.int32)
    symbol[numbers] = np.arange(1, len(numbers) + 1)
    x = np.concatenate([[0], symbol[sequence], [0]]).astype(np.int32)
    alone = np.zeros(len(x), dtype=bool)
    alone[1:-1] = (x[:-2] == 0) & (x[2:] == 0)
    x = np.where(alone, 0, x)
    return x[(x != 0) | (np.concatenate([[1], x[:-1]]) != 0)]


def _build(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _INDEX.empty_table()
    row = left.to_pylist()[0]
    raw = unsqueeze(row["sequence"])
    numbers, ids = right.column("number").to_numpy().astype(np.int64), right.column("id").to_numpy()
    order = np.argsort(numbers)
    x = shard_symbols(Reader(raw).numbers(len(raw) // 4), numbers[order])
    made = [ids[order].astype(np.int64).tobytes(), planes(transform(x), _WIDTH), planes(transform(x[::-1]), _WIDTH)]
    return pa.Table.from_arrays([pa.array([row["shard"]]), *(pa.array([squeeze(m)], type=pa.binary()) for m in made)], schema=_INDEX)


Level = tuple[np.ndarray, ...]


class Index:
    """A shard's two transforms. Symbol 0 separates; symbol s is the word with id ``ids[s - 1]``.

    A level of phrases is (ids, first symbol, last symbol, forward start, backward start, size), by forward start.
    """

    def __init__(self, ids: np.ndarray, forward: np.ndarray, backward: np.ndarray):
        self.ids, self.n = ids, len(forward)
        self.counts = np.bincount(backward, minlength=len(ids) + 1)
        # a symbol's places in a transform, in order: how many lie before an interval is a search
        self.forward, self.backward = _sorted_places(forward), _sorted_places(backward)
        self.put_behind = np.empty(self.n, dtype=np.int64)
        self.put_behind[self.backward & 0xFFFFFFFF] = np.arange(self.n)

    def words(self) -> Level:
        """The level of single words."""
        start, symbol = np.cumsum(self.counts)[:-1], np.arange(1, len(self.counts))
        return self.ids, symbol, symbol, start, start, self.counts[1:]

    def extensions(self, level: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What one more word makes of a level's phrases, if what remains without the first word is in the level as well:
        (id of the phrase, id of what remains, occurrences)."""
        ids, _, _, forward, backward, size = level
        starts, total = np.cumsum(size) - size, int(size.sum())
        which = np.repeat(np.arange(len(ids)), size)
        key = which * self.n + self.put_behind[np.repeat(backward - starts, size) + np.arange(total)]
        key.sort()
        symbol = np.repeat(np.arange(len(self.counts)), self.counts)[key - which * self.n]
        begin = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (symbol[1:] != symbol[:-1])])) if total else np.zeros(0, dtype=np.int64)
        owner = which[begin]
        # the extension's forward interval, and where it lies without its first word
        rest = self.forward[forward[owner] + begin - starts[owner]] & 0xFFFFFFFF
        at = np.maximum(np.searchsorted(forward, rest, side="right") - 1, 0)
        ok = (symbol[begin] != 0) & (rest >= forward[at]) & (rest < forward[at] + size[at])
        return ids[owner][ok], ids[at][ok], np.diff(np.append(begin, total))[ok]

    def next_level(self, level: Level, prefix: np.ndarray, suffix: np.ndarray, ids: np.ndarray) -> Level:
        """The phrases with these parents in the level: a step behind the one, a step before the other."""
        by_id = np.argsort(level[0])
        known = level[0][by_id]
        p, s = by_id[np.searchsorted(known, prefix)], by_id[np.searchsorted(known, suffix)]
        first, last = level[1][p], level[2][s]
        low = np.searchsorted(self.backward, (last << 32) | level[4][p])
        high = np.searchsorted(self.backward, (last << 32) | (level[4][p] + level[5][p]))
        forward = np.searchsorted(self.forward, (first << 32) | level[3][s])
        order = np.argsort(forward)
        return tuple(c[order] for c in (ids, first, last, forward, low, high - low))


def _read(row: dict) -> Index:
    def numbers(c: str) -> np.ndarray:
        raw = unsqueeze(row[c])
        return Reader(raw).numbers(len(raw) // _WIDTH, _WIDTH)

    return Index(np.frombuffer(unsqueeze(row["ids"]), dtype=np.int64), numbers("forward"), numbers("backward"))


def _columns(*columns: np.ndarray) -> bytes:
    """Numbers of equal count side by side, the first one ascending."""
    first = np.diff(columns[0], prepend=0)
    return squeeze(b"".join(planes(c, 8) for c in (first, *columns[1:])))


def _uncolumns(data: bytes, n_columns: int) -> list[np.ndarray]:
    raw = unsqueeze(data)
    reader, n = Reader(raw), len(raw) // (8 * n_columns)
    columns = [reader.numbers(n, 8) for _ in range(n_columns)]
    return [np.cumsum(columns[0]), *columns[1:]]


def _by_part(shard: int, counted: tuple[np.ndarray, np.ndarray, np.ndarray], parts: int) -> pa.Table:
    """What a shard counts, packed by the range that a phrase's parents hash to."""
    prefix, suffix, n = (c.astype(np.int64) for c in counted)
    mixed = (prefix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (suffix.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    part = (((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64) % parts
    order = np.lexsort((suffix, prefix, part))
    edges = [0, *(np.flatnonzero(np.diff(part[order])) + 1).tolist(), len(order)] if len(order) else [0]
    groups = [order[a:b] for a, b in itertools.pairwise(edges)]
    rows = [pa.array([int(part[g[0]]) for g in groups], type=pa.int32()), pa.array([shard] * len(groups), type=pa.int64()), pa.array([_columns(prefix[g], suffix[g], n[g]) for g in groups], type=pa.binary())]
    return pa.Table.from_arrays(rows, schema=_COUNTED)


def _pairs(parts: int):
    """Phrases of two words of each shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                index = _read(row)
                yield from _by_part(row["shard"], index.extensions(index.words()), parts).to_batches()

    return rows


def _longer(parts: int):
    """A shard's phrases one word longer than its last level of frequent ones, all of whose levels are told."""

    def rows(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows or not left.num_rows:
            return _COUNTED.empty_table()
        row, told = left.to_pylist()[0], defaultdict(list)
        for r in right.select(["level", "data"]).to_pylist():
            told[r["level"]].append(_uncolumns(r["data"], 3))
        index = _read(row)
        level = index.words()
        for length in sorted(told):
            level = index.next_level(level, *(np.concatenate(c) for c in zip(*told[length], strict=True)))
        return _by_part(row["shard"], index.extensions(level), parts)

    return rows


def _settle(level: int, min_count: int):
    """The owner of a range: sums over shards, the frequent phrases as rows, and to each shard those of its own."""

    def rows(group: pa.Table) -> pa.Table:
        part, shards = group.column("part")[0].as_py(), group.column("shard").to_pylist()
        held = [_uncolumns(d.as_py(), 3) for d in group.column("data")]
        prefix, suffix, n = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.lexsort((suffix, prefix))
        p, s = prefix[order], suffix[order]
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1])])
        begin = np.flatnonzero(new)
        total = np.add.reduceat(n[order], begin)
        kept = total >= min_count
        ids = np.where(kept, (part << _NUMBER_BITS) + np.cumsum(kept) - 1, -1)
        own = np.empty(len(order), dtype=np.int64)
        own[order] = ids[np.cumsum(new) - 1]
        frequent = pa.table({"prefix": p[begin][kept], "suffix": s[begin][kept], "a": total[kept], "id": ids[kept]})
        none = pa.nulls(frequent.num_rows, pa.int64())
        tables = [pa.Table.from_arrays([*frequent.columns, none, pa.nulls(frequent.num_rows, pa.int32()), pa.nulls(frequent.num_rows, pa.binary())], schema=_SETTLED)]
        at, answers = 0, []
        for shard, (p, s, _) in zip(shards, held, strict=True):
            mine = own[at : at + len(p)]
            at += len(p)
            if (mine >= 0).any():
                answers.append({"prefix": None, "suffix": None, "a": None, "id": None, "shard": shard, "level": level, "data": _columns(p[mine >= 0], s[mine >= 0], mine[mine >= 0])})
        return pa.concat_tables([*tables, pa.Table.from_pylist(answers, schema=_SETTLED)])

    return rows


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder that is dealt by shard, so that no later step shuffles it again."""
    spark, name = df.sparkSession, f"phrase_index_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, "shard").option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def frequent_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> tuple[DataFrame, list[DataFrame]]:
    """Word counts (lang, n), and for each length from 1 on a table of the phrases that occur ``min_count`` times or
    more: (id, lang, phrase, last, a, prefix, suffix, lefts, rights). ``lefts`` are the counts of the first 1, 2 ...
    words, ``rights`` those of the last 1, 2 ...; ``prefix`` and ``suffix`` are ids in the table before.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    shards = saved(texts.mapInArrow(_pack, SHARD), "phrase-shards")
    totals = saved(shards.select(F.explode(F.arrays_zip("langs", "lang_words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.lang_words").alias("n")), "phrase-totals")
    words = shards.select("shard", "langs", "books", "words", "counts").mapInArrow(_word_rows, "lang string, word binary, shard long, number int, n long")
    # one shuffle counts a word over its shards and leaves its shards' rows, each with the word's id
    same = Window.partitionBy("lang", "word")
    own = F.shiftleft("shard", _NUMBER_BITS).bitwiseOR(F.col("number"))
    known = saved(words.withColumn("a", F.sum("n").over(same)).withColumn("id", F.min(own).over(same)).filter(F.col("a") >= min_count), "phrase-words")
    none, text = F.array().cast("array<long>"), F.col("word").cast("string")
    first = known.filter(own == F.col("id")).select("id", "lang", text.alias("phrase"), text.alias("last"), "a", F.lit(None).cast("long").alias("prefix"), F.lit(None).cast("long").alias("suffix"), none.alias("lefts"), none.alias("rights"))
    levels = [saved(first, "phrases-1")]
    row = shards.agg(F.count("*").alias("shards"), F.sum(F.aggregate("lang_words", F.lit(0).cast("long"), lambda x, y: x + y)).alias("words")).first()
    parts, buckets = 1 + (row["words"] or 0) // RANGE_WORDS, max(1, min(2 * row["shards"], 512), row["shards"] // 8)
    index = _bucketed(shards.select("shard", "sequence").groupBy("shard").cogroup(known.select("shard", "number", "id").groupBy("shard")).applyInArrow(_build, INDEX), buckets)
    told = None
    for length in range(2, max_words + 1):
        if told is None:
            counted = index.mapInArrow(_pairs(parts), COUNTED)
        else:
            counted = index.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_longer(parts), COUNTED)
        settled = saved(counted.groupBy("part").applyInArrow(_settle(length, min_count), SETTLED), f"phrase-settled-{length}")
        before = levels[-1]
        left = before.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("head"), F.col("a").alias("left"), "lefts")
        right = before.select(F.col("id").alias("suffix"), "last", F.col("a").alias("right"), "rights")
        level = settled.filter("shard IS NULL").select("prefix", "suffix", "a", "id").join(left, "prefix").join(right, "suffix").select(
            "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "prefix", "suffix",
            F.concat("lefts", F.array("left")).alias("lefts"), F.concat("rights", F.array("right")).alias("rights"),
        )
        levels.append(saved(level, f"phrases-{length}"))
        answers = settled.filter("shard IS NOT NULL").select("shard", "level", "data")
        told = answers if told is None else told.unionByName(answers)
    return totals, levels


def collocations(docs: DataFrame, top: int = TOP, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT) -> DataFrame:
    """The best phrases of each language: (lang, rank, phrase, a, l, r, n, score), ``top`` of each.

    Candidates are phrases of 2 to ``max_words`` words that occur ``min_count`` times or more within pieces of texts
    (cut at ``.,;:!?`` and line ends; words are cut at blanks and tabs; A-Z in lower case). A candidate's score is
    floor(1000 a n / (l r)) of its worst cut, in exact decimals. One that lies in a longer candidate of the same count is
    dropped; since counts fall with length, a longer candidate by one word then has that count as well.
    Null texts count as empty, a null language is ``und``, repeated rows count again, ties go by a and then by the
    phrase's bytes. Empty tables and texts give no rows; other columns are not read; a very long text is cut between
    pieces and goes over several shards.
    """
    totals, levels = frequent_phrases(docs, max_words, min_count)
    scored = None
    for at, level in enumerate(levels[1:], 1):
        kept = level
        if at + 1 < len(levels):
            longer = levels[at + 1]
            same = longer.select(F.col("prefix").alias("id"), "a").unionByName(longer.select(F.col("suffix").alias("id"), "a"))
            kept = level.join(same, ["id", "a"], "left_anti")
        rows = kept.select("lang", "phrase", "a", "lefts", "rights")
        scored = rows if scored is None else scored.unionByName(rows)
    if scored is None:
        raise ValueError("phrases have two words or more")
    cut = """transform(sequence(1, size(lefts)), k -> struct(
        (cast(1000 as decimal(38,0)) * a * n) div (cast(lefts[k - 1] as decimal(38,0)) * rights[size(rights) - k]) as score, k as k,
        lefts[k - 1] as l, rights[size(rights) - k] as r))"""
    scored = scored.join(totals, "lang").withColumn("cut", F.array_min(F.expr(cut))).select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    # the best of each part of a language, then the best of those: no task sorts all phrases of one language
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    some = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts))).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("rank") <= top)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).filter(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
