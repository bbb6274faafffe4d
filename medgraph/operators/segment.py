"""Words of Thai text, which is written without blanks.

Every run of Thai characters becomes a lattice: its nodes are the places where a word may begin, its arcs are the words
of a dictionary. The best path leaves the fewest characters outside the dictionary, then has the fewest words, then the
longest word first. What no word covers is one token from end to end. The dictionary is the user's; while its measured
size is within BROADCAST_BYTES each task holds it as a trie, beyond that Spark joins the runs' substrings with it and
each run gets its own words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import PSEUDONYM, THAI
from ..sources.scratch import stored

#: UTF-8 bytes of all words up to which tasks hold the dictionary.
BROADCAST_BYTES = 16 << 20
#: Vowels that are written before their consonant (no word ends there), and vowels and marks that belong to
#: the character before (no word begins there).
LEADING = "เแโใไ"
TRAILING = "ะัาำิีึืฺุูๅ็่้๊๋์ํ๎"
#: Tokens of a text: a run of Thai, a Latin word, a number.
TOKENS = rf"{THAI}+|[-a-z]*[a-z][-a-z]*|\d+(?:[,.]\d+)*"

_FAR = 1 << 60
#: A character outside the dictionary costs more than any number of words; a word costs 1.
_OUTSIDE = 1 << 32


def trie(words: Iterable[str]) -> dict:
    """Nested dictionaries by character; the key "" ends a word."""
    root: dict = {}
    for word in words:
        node = root
        for c in word:
            node = node.setdefault(c, {})
        if word:
            node[""] = True
    return root


def _starts(run: str) -> list[bool]:
    """For each place, the end included, whether a word may begin (or the last one end) there."""
    inner = [run[i] not in TRAILING and run[i - 1] not in LEADING for i in range(1, len(run))]
    return [True, *inner, True]


def best_path(run: str, words: dict) -> list[str]:
    """Tokens of a run of Thai, from a trie of words; linear in the run for words of bounded length."""
    n, starts = len(run), _starts(run)
    known, outside = [_FAR] * (n + 1), [_FAR] * (n + 1)  # least cost from a place, in a word or outside of all
    step, after = [0] * (n + 1), [n] * (n + 1)  # length of the best word, next place where one may begin
    known[n] = 0
    following = n
    for i in range(n - 1, -1, -1):
        if not starts[i]:
            continue
        after[i] = following
        outside[i] = (following - i) * _OUTSIDE + min(outside[following], known[following] + 1)
        following = i
        node, j = words.get(run[i]), i + 1
        while node is not None:
            if "" in node and starts[j]:
                cost = 1 + min(known[j], outside[j])
                if cost <= known[i]:
                    known[i], step[i] = cost, j - i
            node = node.get(run[j]) if j < n else None
            j += 1
    out, i = [], 0
    while i < n:
        if known[i] <= outside[i]:
            out.append(run[i : i + step[i]])
            i += step[i]
            continue
        begin = i
        while True:
            i = after[i]
            if known[i] + 1 <= outside[i]:
                break
        out.append(run[begin:i])
    return out


def _is_thai(token: str) -> bool:
    return "฀" <= token[0] <= "๿"


def segment(texts: DataFrame, words: DataFrame, text: str = "text", word: str = "word", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``texts`` with the column ``tokens``: words of Thai runs, Latin words and numbers of the lower-case text, in order.
    Pseudonyms are left out.

    Null texts have null tokens, empty ones none. Null, empty and repeated words count for nothing; without words a run
    is one token. Runs of any length are read whole.
    """
    spark = texts.sparkSession
    once = words.select(F.lower(word).alias("w")).filter("w <> ''").distinct()
    size = once.agg(F.sum(F.octet_length("w")).alias("bytes"), F.max(F.length("w")).alias("longest")).first()
    pieces = F.regexp_extract_all(F.regexp_replace(F.lower(F.col(text)), PSEUDONYM, " "), F.lit(TOKENS), F.lit(0))
    if (size["bytes"] or 0) <= broadcast_bytes:
        held = sorted(r["w"] for r in once.collect())  # at most broadcast_bytes

        @F.pandas_udf("array<string>")
        def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            root = trie(held)
            for batch in batches:
                yield batch.map(lambda found: None if found is None else [t for x in found for t in (best_path(x, root) if _is_thai(x) else [x])])

        return texts.withColumn("tokens", cut(pieces))

    # each distinct run once, under its hash: runs may be long, and their substrings are many
    placed = stored(texts.withColumn("_id", F.monotonically_increasing_id()).withColumn("_pieces", pieces))
    runs = placed.select(F.explode("_pieces").alias("run")).filter(F.rlike("run", F.lit(THAI))).distinct().withColumn("h", F.sha2("run", 256))
    places = runs.select("h", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("at")).select("h", F.substr("run", F.col("at"), F.lit(size["longest"])).alias("ahead"))
    parts = places.distinct().select("h", F.explode(F.transform(F.sequence(F.lit(1), F.length("ahead")), lambda n: F.substr("ahead", F.lit(1), n))).alias("w"))
    own = parts.distinct().join(once, "w").groupBy("h").agg(F.collect_set("w").alias("own"))

    @F.pandas_udf("array<string>")
    def path(run: pd.Series, own: pd.Series) -> pd.Series:
        return pd.Series([best_path(r, trie(w if w is not None else ())) for r, w in zip(run, own, strict=True)])

    cut_runs = runs.join(own, "h", "left").select("run", path("run", "own").alias("words"))
    exploded = placed.select("_id", F.posexplode("_pieces").alias("at", "piece")).join(cut_runs, F.col("piece") == F.col("run"), "left")
    tokens = exploded.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("words", F.array("piece")).alias("words")))).alias("all"))
    none = F.when(F.col("_pieces").isNotNull(), F.array().cast("array<string>"))
    return placed.join(tokens, "_id", "left").withColumn("tokens", F.coalesce(F.flatten("all.words"), none)).drop("_id", "_pieces", "all")
