"""Mixing: targets against the rule by hand, budgets against all subsets, the query as a whole."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from medgraph.llm import mixing
from medgraph.llm.queries import QUERIES

CLASH = "doc_id long, source string, text string, size long, n long, hash long, target double"


def _targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left, parts = total - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in names if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else left * weight[s] / parts for s in names}
        above = {s for s in names if s not in capped and target[s] > 3 * sizes[s]}
        if not above:
            return target
        capped |= above


def _check(rows, got):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, _, t in rows]
    by_source = Counter()
    for (_, s, _), n in zip(rows, size, strict=True):
        by_source[s] += n
    target = _targets(by_source)
    assert Counter((r[0], r[1], r[2]) for r in got) == Counter((i, n, by_source[s]) for (i, s, _), n in zip(rows, size, strict=True))
    source_of, taken, most = {i: s for i, s, _ in rows}, Counter(), defaultdict(int)
    for r in got:
        s = source_of[r[0]]
        assert r[3] == pytest.approx(target[s], abs=1e-6)
        assert 0 <= r[4] <= 3 * r[1] and (r[4] % r[1] == 0 if r[1] else r[4] == 0)
        taken[s] += r[4]
        most[s] = max(most[s], r[1])
    for s in by_source:
        assert abs(taken[s] - target[s]) <= most[s]
    return taken, target


def _rows():
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", "Z", "é", "hot", "hot", "hot", None]), "w " * rng.choice([0, 1, 3, 3, 3, 7, rng.randint(1, 200)])) for i in range(400)]
    return [*rows, *((1000 + i, "hot", "same size here") for i in range(300)), (5000, "one", "x " * 90_000), (5001, "none", None), (5001, "none", None), (5002, "tiny", "a b"), (5002, "tiny", "a b"), (5003, "", " \t\n")]


def test_whole_table(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, s, t, 1, 2, 3, 4.0) for i, s, t in rows], CLASH)
    got = [tuple(r) for r in mixing.mix(df).collect()]
    taken, target = _check(rows, got)
    for s in ("hot", "a", "b", "Z"):  # many small documents: the sum is met
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6 or target[s] == pytest.approx(3 * sum(r[1] for r in got if dict((i, x) for i, x, _ in rows)[r[0]] == s))
    again = [tuple(r) for r in mixing.mix(df.repartition(7)).collect()]
    assert sorted(again, key=str) == sorted(got, key=str)


def test_hot_group_is_chosen_by_its_hashes(spark):
    rows = [(i, s, "three words here") for i, s in enumerate(["a"] * 900 + ["b"] * 100)]
    got = [tuple(r) for r in mixing.mix(spark.createDataFrame([(i, s, t, 1, 2, 3, 4.0) for i, s, t in rows], CLASH)).collect()]
    _check(rows, got)
    assert sum(r[4] for r in got if r[0] < 900) == 2100 and sum(r[4] for r in got if r[0] >= 900) == 900
    other = [tuple(r) for r in mixing.mix(spark.createDataFrame([(i, s, t, 1, 2, 3, 4.0) for i, s, t in rows], CLASH), seed=12).collect()]
    assert sorted(other) != sorted(got)


def test_budgets_against_all_subsets():
    rng = random.Random(9)
    for _ in range(200):
        sizes = rng.sample(range(1, 60), rng.randint(1, 5))
        counts = [rng.randint(1, 3) for _ in sizes]
        budget = rng.randint(0, sum(s * c for s, c in zip(sizes, counts, strict=True)))
        taken = mixing.subset_counts(np.array(sizes), np.array(counts), budget)
        assert all(0 <= k <= c for k, c in zip(taken, counts, strict=True))
        reach = {sum(k * s for k, s in zip(ks, sizes, strict=True)) for ks in itertools.product(*(range(c + 1) for c in counts))}
        got = sum(int(k) * s for k, s in zip(taken, sizes, strict=True))
        assert abs(got - budget) == min(abs(r - budget) for r in reach)


def test_large_budget_takes_every_length_in_proportion():
    sizes, counts = np.arange(1, 400), np.full(399, 1000)
    for share in (0.1, 0.5, 0.97):
        budget = int(share * (sizes * counts).sum())
        taken = mixing.subset_counts(sizes, counts, budget)
        assert (taken * sizes).sum() == budget
        assert abs(taken[50:] / counts[50:] - share).mean() < 0.02


def test_empty_and_wordless_tables(spark):
    assert mixing.mix(spark.createDataFrame([], CLASH)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None, 1, 2, 3, 4.0), (1, None, "", 1, 2, 3, 4.0)], CLASH)).collect()
    assert [tuple(r) for r in got] == [(1, 0, 0, 0.0, 0)] * 2


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "source", "text").collect()]
    _check(rows, [tuple(r) for r in QUERIES["op11_mixing"](spark, folder).collect()])
