"""The language model: contract figures by brute force, seating invariants, held-out perplexity."""

import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np

from medgraph.llm import lm


def _rows():
    rng = random.Random(3)
    nxt = {w: rng.sample(range(40), 3) for w in range(40)}
    rows = []
    for i in range(300):
        w, out = rng.randrange(40), []
        for _ in range(rng.randint(5, 60)):
            out.append(f"W{w}é" if rng.random() < 0.97 else f"rare{rng.randint(0, 10**6)}")
            w = rng.choice(nxt[w])
        rows.append((i, " ".join(out)))
    return rows + [(1000, None), (1001, ""), (1002, "w1é w1é"), (1002, "w1é w1é"), (None, "no id \x1c here"), (1003, "word " * 3000)]


def test_contract_figures_and_perplexity(spark):
    rows = _rows()
    docs = spark.createDataFrame([(i, t, 0.5, True) for i, t in rows], "doc_id long, text string, score double, held_out boolean")
    scored = lm.score(docs, block_bytes=4000)
    got = scored.collect()
    tokens = [[w.lower() for w in (t or "").encode().split()] + [None] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = Counter(w for ws, h in zip(tokens, held, strict=True) if not h for w in ws)
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), h, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), 6)) for (i, _), h, ws in zip(rows, held, tokens, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    per = {r.held_out: r for r in lm.perplexity(scored).collect()}
    assert per[True].perplexity < 0.5 * per[True].base_perplexity
    again = {(r.doc_id, r.score) for r in lm.score(docs, block_bytes=4000).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def _rising(a, step, n):
    return math.prod(a + step * i for i in range(n))


def _stirling(c, t, d):
    """Weight of all seatings of c customers at t tables, by putting the last customer down."""
    if c == 0:
        return 1.0 if t == 0 else 0.0
    if t == 0 or t > c:
        return 0.0
    return _stirling(c - 1, t - 1, d) + (c - 1 - d * t) * _stirling(c - 1, t, d)


def _exact(context, word, customers, base, n_contexts):
    """Predictive probabilities by going through every seating of contexts and parent."""
    d, th, d1, th1 = lm.DISCOUNT, lm.STRENGTH, lm.PARENT_DISCOUNT, lm.PARENT_STRENGTH
    total, out = 0.0, np.zeros(len(customers))
    for t in itertools.product(*(range(1, c + 1) if c else (0,) for c in customers)):
        m = [sum(x for x, w in zip(t, word, strict=True) if w == k) for k in range(len(base))]
        tables = [sum(x for x, u in zip(t, context, strict=True) if u == k) for k in range(n_contexts)]
        below = [sum(c for c, u in zip(customers, context, strict=True) if u == k) for k in range(n_contexts)]
        seats = math.prod(_stirling(c, x, d) for c, x in zip(customers, t, strict=True)) * math.prod(_rising(th, d, x) for x in tables)
        for s in itertools.product(*(range(1, n + 1) if n else (0,) for n in m)):
            weight = seats * math.prod(_stirling(n, x, d1) * b**x for n, x, b in zip(m, s, base, strict=True)) * _rising(th1, d1, sum(s)) / _rising(th1, 1, sum(m))
            parent = [(n - d1 * x + (th1 + d1 * sum(s)) * b) / (th1 + sum(m)) for n, x, b in zip(m, s, base, strict=True)]
            total += weight
            out += weight * np.array([(c - d * x + (th + d * tables[u]) * parent[w]) / (th + below[u]) for c, x, u, w in zip(customers, t, context, word, strict=True)])
    return out / total


def test_sampled_seatings_against_all_seatings():
    context, word = np.array([0, 0, 1, 1, 2, 0, 2]), np.array([0, 1, 0, 2, 1, 2, 3])
    customers, base = np.array([4, 1, 3, 2, 3, 0, 0]), np.array([0.3, 0.1, 0.05, 0.2])
    want = _exact(context, word, customers, base, 3)
    got = lm.averaged(context, word, customers, base, 3, 1, sweeps=4000, draws=3900)
    assert np.abs(got / want - 1).max() < 0.03


def test_tables_of_one_dish_follow_their_conditional():
    # two customers: a second table weighs the restaurant's open weight, with the first table in it, against 1 - d
    n = 200_000
    t = lm.draw_tables(np.full(n, 2), np.full(n, 1.5), 0.5, lambda at, i: np.full((len(at), 1), 0.5) + 0 * i, np.random.default_rng(0))
    assert abs((t == 2).mean() - 1.0 / (1.0 + 0.5)) < 0.01


def test_saddle_point_continues_the_recursion():
    t = np.array([2.0, 5, 20, 100, 400, 900])
    exact = lm.log_seatings(0.8)[1024, t.astype(int)]
    assert np.abs(lm.log_seatings_far(1024.0, t, 0.8) - exact).max() < 0.06
    assert np.allclose(lm.log_gamma(np.array([0.2, 1.0, 50.5])), [math.lgamma(x) for x in (0.2, 1.0, 50.5)])
    # a dish just beyond the recursion is seated as one just within it
    rng = np.random.default_rng(1)
    p = lambda at, i: np.full((len(at), 1), 0.01) + 0 * i
    near, far = (np.mean([lm.draw_tables(np.array([c]), np.array([60.0]), 0.8, p, rng)[0] for _ in range(300)]) for c in (lm.EXACT, lm.EXACT + 1))
    assert abs(near / far - 1) < 0.05


def test_seating_invariants():
    rng = np.random.default_rng(2)
    context, word = np.repeat(np.arange(30), 20), np.tile(np.arange(20), 30)
    customers = rng.geometric(0.2, 600) - 1
    customers[5] = 10**10
    seated = customers > 0
    room = lm.Seating(context[seated], word[seated], customers[seated], np.full(20, 0.05), 30, 3)
    for _ in range(3):
        room.sweep()
        assert ((room.t >= 1) & (room.t <= room.c)).all()
        assert (room.m == np.bincount(room.word, room.t, 20)).all() and (room.s <= room.m).all() and (room.s >= np.minimum(room.m, 1)).all()
    p = room.predictive(context, word, np.where(seated, np.cumsum(seated) - 1, -1))
    assert np.allclose(np.bincount(context, p), 1.0)  # all words of a context, with a base that sums to one


def test_a_refined_context_splits_a_hot_word(spark, monkeypatch):
    monkeypatch.setattr(lm, "REFINE", 50)
    docs = spark.createDataFrame([(i, f"a{i % 7} the b{i % 7} the c{i % 3}") for i in range(200)] + [(999, "the " * 4000)], "doc_id long, text string")
    got = lm.score(docs).collect()
    assert len(got) == 201 and all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score(docs).count() == 0
    only_held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    (r,) = lm.score(spark.createDataFrame([(only_held, "a b")], "doc_id long, text string")).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)
