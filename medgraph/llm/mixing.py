"""Mixing sources to target weights by subset sums over document lengths.

Each source has a target in words. Its documents are counted by exact length; whole passes over the source are taken
first, and the rest of its budget is a bounded knapsack over the lengths: how many documents of each length to take once
more. All but a bounded rest is taken in proportion, so that every length has its share, and the rest is settled by
dynamic programming over sums. Which documents of a length are taken is decided by a seeded hash.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import clean_docs, numbered, saved

WEIGHTS, MAX_REPEATS, SEED = (1, 2, 3), 3, 11
#: Words of a source's budget that the dynamic programming settles. It bounds the sums that a task holds.
WINDOW = 1 << 16
PLAN = "source string, size long, n long, passes int, extra long"


def document_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size): words of each whole text, null texts none."""
    return clean_docs(docs, F.col("source").cast("string").alias("source")).select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target): the words of all sources, shared by weight. Sources in code-point order, null last,
    weigh ``weights``, repeating. A target above ``cap`` times its source stops there, and what is left is shared again
    among the others until none is above. Each round reads two numbers, however many sources there are."""
    totals = saved(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    ordered = numbered(totals.withColumn("last", F.col("source").isNull()), ["last", "source"], "place").drop("last")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    table = saved(ordered.select("source", "source_size", weight.cast("long").alias("weight")), "source-weights")
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    share = Fraction(0)
    wide = "decimal(38,0)"

    def above(at: Fraction):
        return F.col("weight").cast(wide) * F.lit(at.numerator).cast(wide) > F.col("source_size").cast(wide) * F.lit(cap * at.denominator).cast(wide)

    while whole:
        stopped = above(share)
        row = table.agg(F.sum(F.when(stopped, F.col("source_size") * cap)).alias("full"), F.sum(F.when(~stopped, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        found = Fraction(whole - (row["full"] or 0), int(row["open"]))
        if found == share:
            break
        share = found
    target = F.when(above(share), (F.col("source_size") * cap).cast("double")).otherwise(F.col("weight") * F.lit(float(share)))
    return table.select("source", "source_size", target.alias("target"))


def subset_counts(sizes: np.ndarray, counts: np.ndarray, budget: int, window: int = WINDOW, seed: int = SEED) -> np.ndarray:
    """How many documents of each size to take, at most ``counts`` of each, for a sum next to ``budget`` (sizes are
    positive and differ; of two sums equally near, the lower).

    Beyond the window, documents are taken in proportion, what a size leaves over passing to the next smaller one. The
    rest is a bounded knapsack: sums within reach, as bits of one number, grown by 1, 2, 4 ... documents of a size at a
    time, sizes in seeded order so that no length is preferred, until the budget itself is reached or no size is left.
    Then the nearest sum is walked back.
    """
    taken = np.zeros(len(counts), dtype=np.int64)
    if not len(sizes) or budget <= 0:
        return taken
    total, ahead = int((sizes * counts).sum()), budget - window
    if ahead > 0:
        due = 0.0
        for i in np.argsort(-sizes).tolist():
            due += ahead / total * float(counts[i]) * float(sizes[i])
            taken[i] = k = min(int(counts[i]), max(0, int(due // float(sizes[i]))))
            due -= k * float(sizes[i])
    rest = budget - int((taken * sizes).sum())
    limit = min(rest + int(sizes.max()), 2 * rest)  # a sum above twice the rest is never the nearest
    keep, reach, steps = (1 << (limit + 1)) - 1, 1, []
    for i in np.random.default_rng(seed).permutation(len(sizes)).tolist():
        left, size, k = min(int(counts[i] - taken[i]), limit // int(sizes[i])), int(sizes[i]), 1
        while left > 0 and not (reach >> rest) & 1:
            k = min(k, left)
            steps.append((i, k, reach))
            reach |= (reach << (k * size)) & keep
            left, k = left - k, 2 * k
    at = (reach & ((1 << (rest + 1)) - 1)).bit_length() - 1
    if over := reach >> (rest + 1):
        high = rest + (over & -over).bit_length()
        at = high if high - rest < rest - at else at
    for i, k, before in reversed(steps):
        if not (before >> at) & 1:
            at -= k * int(sizes[i])
            taken[i] += k
    return taken


def _plan(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("size")
    sizes, counts = group["size"].to_numpy(), group["n"].to_numpy()
    whole, budget = int(group["source_size"].iloc[0]), round(float(group["target"].iloc[0]))
    passes = min(MAX_REPEATS, budget // whole) if whole else 0
    extra = np.zeros(len(sizes), dtype=np.int64)
    if passes < MAX_REPEATS:
        some = sizes > 0
        extra[some] = subset_counts(sizes[some], counts[some], budget - passes * whole)
    return pd.DataFrame({"source": group["source"], "size": sizes, "n": counts, "passes": passes, "extra": extra})


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs``: (doc_id, size, source_size, target, taken).

    ``taken`` is the words that the mix takes of it: 0 to 3 times its size. Targets are as in ``source_targets``; each
    source's taken words come as near to its target as whole documents allow. Among documents of one source and size the
    seeded hash of doc_id decides, so reruns agree; documents that share all three are alike, and so are repeated rows.
    Null and empty texts have size 0 and are never taken; a null source is one of its own; a very long text is one
    document, taken whole or not at all. An empty table gives no rows, and other columns are not read.
    """
    # texts are read once; from here on rows are four numbers
    rows = saved(document_sizes(docs).withColumn("hash", F.xxhash64("doc_id", F.lit(seed))), "mix-sizes")
    targets = saved(source_targets(rows), "mix-targets")
    lengths = rows.groupBy("source", "size").agg(F.count("*").alias("n"))
    same_source = lengths["source"].eqNullSafe(targets["source"])
    # a group holds one row for each length of a source, not its documents
    plan = saved(lengths.join(targets, same_source).select(lengths["source"], "size", "n", "source_size", "target").groupBy("source").applyInPandas(_plan, PLAN), "mix-plan")
    plan = plan.join(targets, plan["source"].eqNullSafe(targets["source"])).select(plan["source"].alias("of"), plan["size"].alias("length"), "n", "passes", "extra", "source_size", "target")
    of_plan = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("length"))
    met = saved(rows.join(plan, of_plan).drop("of", "length"), "mix-met")
    whole = met.filter("extra = 0 OR extra = n").withColumn("more", (F.col("extra") > 0).cast("int"))
    # the other groups: about as many buckets of hashes as documents in each, so that no task orders a whole group
    part = met.filter("extra > 0 AND extra < n").withColumn("bucket", F.shiftright(F.shiftrightunsigned("hash", 33) * F.ceil(F.sqrt("n")), 31))
    counts = part.groupBy("source", "size", "extra", "bucket").agg(F.count("*").alias("held"))
    upto = F.sum("held").over(Window.partitionBy("source", "size").orderBy("bucket"))
    cut = counts.withColumn("upto", upto).filter("upto >= extra AND upto - held < extra").select(F.col("source").alias("of"), F.col("size").alias("length"), F.col("bucket").alias("cut"), (F.col("extra") - F.col("upto") + F.col("held")).alias("left"))
    part = part.join(cut, of_plan)
    sure = part.filter("bucket <> cut").withColumn("more", (F.col("bucket") < F.col("cut")).cast("int"))
    at = F.row_number().over(Window.partitionBy("source", "size").orderBy("hash", "doc_id"))
    edge = part.filter("bucket = cut").withColumn("at", at).withColumn("more", (F.col("at") <= F.col("left")).cast("int"))
    columns = ["doc_id", "size", "source_size", "target", (F.col("size") * (F.col("passes") + F.col("more"))).cast("long").alias("taken")]
    return whole.select(*columns).unionByName(sure.select(*columns)).unionByName(edge.select(*columns))
