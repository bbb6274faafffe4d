"""Spelling variants: words one edit apart, found by pivotal bigrams.

Bigrams are ordered by how often they stand in words, rare ones first. A word's prefix is its three rarest bigrams (and
all that tie with the third); two of them that do not overlap are its pivots, the rarest such pair, by dynamic
programming over their positions. One edit spoils at most one of two bigrams that do not overlap. So of two near words,
the one whose prefix ends earlier in the order has a pivot that is untouched and that stands in the other's prefix. The
index holds each prefix bigram at its distance from either end, since an edit moves it from one end only, together with
the text that an edit elsewhere must leave alone. Candidates are verified by edit distance in the join itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import saved

LEAST_CHARS, LEAST_COUNT, EDITED_ONE_IN, FORM_RATIO = 7, 2, 31, 10
#: Bigrams of a prefix: with one edit allowed, two may go, and one more must stay.
PREFIX = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose keys a task makes.
WORDS_A_TASK = 50_000
#: Bits of a bigram's rank.
RANK_BITS = 13
_KEYS = pa.schema([("key", pa.int64()), ("word", pa.string()), ("figures", pa.int64()), ("mask", pa.int64())])
KEYS = "key long, word string, figures long, mask long"


def spelled_words(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, edited_one_in: int = EDITED_ONE_IN) -> DataFrame:
    """(word, n): distinct runs of letters, A-Z in lower case, of enough code points and occurrences. One run in
    ``edited_one_in``, by the checksum of ``<doc_id>:<run>``, loses a code point first. A null doc_id prints as nothing."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{least_chars},}}+"), F.lit(0))).alias("run"))
    # most runs hold no capital, and a look-up of each character is slow
    runs = runs.select("id", F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", _UPPER, _LOWER)).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    at = F.pmod(h, F.char_length("run")).cast("int")
    edited = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    word = F.when(F.pmod(h, F.lit(edited_one_in)) == 0, edited).otherwise(F.col("run"))
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # one condition of both, so that it stays above the counts: words are far fewer than runs
    return counts.filter(F.when(F.col("n") >= least_count, F.char_length("word") >= least_chars).otherwise(F.lit(False)))


def bigram_order(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram, rare ones first. Words of ASCII lower-case letters and À-ÿ have at most 90 * 90."""
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring("word", i, F.lit(2)))).alias("gram"))
    counts = each.groupBy("gram").count().collect()
    return {r["gram"]: i for i, r in enumerate(sorted(counts, key=lambda r: (r["count"], r["gram"])))}


def prefix_and_pivots(word: str, order: dict[str, int]) -> tuple[list[int], list[int], int]:
    """Positions of the prefix bigrams, positions of the two pivots, and the rank at which the prefix ends."""
    ranks = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    last = sorted(ranks)[PREFIX - 1]
    prefix = [i for i, r in enumerate(ranks) if r <= last]
    # least[j]: cheapest bigram that ends before prefix[j] begins; best: cheapest pair whose second is prefix[j]
    best: tuple[int, int, int] | None = None
    least: tuple[int, int] | None = None
    behind = 0
    for i in prefix:
        while prefix[behind] <= i - 2:
            found = (ranks[prefix[behind]], prefix[behind])
            least = found if least is None else min(least, found)
            behind += 1
        if least is not None:
            pair = (least[0] + ranks[i], least[1], i)
            best = pair if best is None else min(best, pair)
    return prefix, [best[1], best[2]], last


def _edit_keys(word: str, places: list[int]) -> set[int]:
    """Keys under which two near words meet, each of which has one of these bigrams beside the edit.

    With ``least`` the length of the shorter word, the first ``half`` or the other code points of it are common to both.
    The bigram lies in the common first part or in the common last part, at the same distance from that end, so what
    they share is: all up to the bigram and the first half, or all up to the bigram and the last half; and the same
    from the other end. A key holds the bigram's distance, which end, and that text, half a word or more.
    """
    n, out = len(word), set()
    for least in (n - 1, n):
        half = least // 2
        tail = least - half
        for i in places:
            upto, since = i + 2, n - i
            out.add(f"<{least} {upto} {word[: max(half, upto)]}")
            if upto < half:
                out.add(f"[{least} {word[:upto]} {word[-tail:]}")
            out.add(f">{least} {since} {word[-max(tail, since) :]}")
            if since < tail:
                out.add(f"]{least} {word[:half]} {word[-since:]}")
    return {xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in out}


def _mask(word: str, order: dict[str, int]) -> int:
    """Parities of a word's letters (32 classes, low half) and of its bigrams (31 classes, high half). One edit changes
    two of the former and four of the latter at most."""
    mask = 0
    for c in word:
        mask ^= 1 << (ord(c) & 31)
    for i in range(len(word) - 1):
        mask ^= 1 << (32 + order[word[i : i + 2]] % 31)
    return mask


def _keys(order: dict[str, int], probe: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            held: list[int] = []
            last: list[int] = []
            mask: list[int] = []
            for word in batch.column(0).to_pylist():
                prefix, pivots, end = prefix_and_pivots(word, order)
                mine = _edit_keys(word, pivots if probe else prefix)
                keys.extend(mine)
                held.append(len(mine))
                last.append(end)
                mask.append(_mask(word, order))
            at = np.repeat(np.arange(len(held)), held)
            # how often the word occurs and where its prefix ends, in one number
            figures = (batch.column(1).to_numpy() << RANK_BITS) | np.array(last, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.int64()), batch.column(0).take(pa.array(at)), pa.array(figures[at]), pa.array(np.array(mask, dtype=np.int64)[at])], schema=_KEYS)

    return rows


def near_words(words: DataFrame) -> DataFrame:
    """Pairs of ``words(word, n)`` that are one inserted, deleted or replaced code point apart: (a, n_a, b, n_b), a < b.
    Words have two code points more than a prefix at least, so that two of its bigrams do not overlap."""
    order = bigram_order(words)
    # the words are a small table that becomes some thirty times as large
    parts = max(words.sparkSession.sparkContext.defaultParallelism, -(-words.count() // WORDS_A_TASK))
    words = words.select("word", "n").repartition(parts, "word")
    ends = (1 << RANK_BITS) - 1
    probes = words.mapInArrow(_keys(order, True), KEYS).select("key", F.col("word").alias("x"), F.col("figures").alias("fx"), F.col("mask").alias("mx"))
    index = words.mapInArrow(_keys(order, False), KEYS).select("key", F.col("word").alias("y"), F.col("figures").alias("fy"), F.col("mask").alias("my"))
    alike = "bit_count((mx ^ my) & 4294967295) <= 2 AND bit_count(shiftright(mx ^ my, 32)) <= 4"
    pairs = probes.join(index, "key").filter(f"(fx & {ends}) <= (fy & {ends}) AND {alike} AND x <> y AND levenshtein(x, y, 1) = 1")
    first, n_x, n_y = F.col("x") < F.col("y"), F.shiftright("fx", RANK_BITS), F.shiftright("fy", RANK_BITS)
    return pairs.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(first, n_x).otherwise(n_y).alias("n_a"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("b"), F.when(first, n_y).otherwise(n_x).alias("n_b")).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms(word, form)``: forms are followed to the last one by pointer doubling. A form is ten times as
    frequent as its word, so a path is as long as a count has digits, and a few joins end it."""
    at = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = saved(at.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            return at


def spelling_forms(docs: DataFrame) -> DataFrame:
    """One row per word of ``docs``: (word, form, root, n, n_near, form_n).

    Words are as ``spelled_words`` says. ``form`` is the most frequent near word (ties: the first in code-point order) if
    it occurs ten times as often, else null; ``root`` is the last form reached; ``n_near`` counts near words. Null and
    empty texts hold no words, a very long text is its words, repeated rows count again, an empty table gives no rows and
    other columns are not read.
    """
    words = saved(spelled_words(docs), "spelling-words")
    pairs = saved(near_words(words), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("other")).alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("less"), F.col("a").alias("other")).alias("near")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("near").alias("near"))
    is_form = -F.col("near.less") >= FORM_RATIO * F.col("n")
    rows = saved(words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near.other")).alias("form"), F.when(is_form, -F.col("near.less")).alias("form_n")), "spelling-forms")
    found = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
