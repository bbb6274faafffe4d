"""Hierarchical Pitman-Yor language model, scored with seatings sampled by Gibbs.

Every previous word is a context with a restaurant of its own. Contexts share parents: each class of contexts (by a
hash of the context's word) has one parent restaurant, where every table of its contexts is a customer; the parents'
base is the smoothed unigram distribution of the corpus. A context with very many customers is refined by a hash of
the word before it, so no restaurant, and no class, grows without bound.

The state of a seating is how many tables serve each dish. A Gibbs step takes all customers of a dish out of its
restaurant and seats them again by their exact conditional: the weight of ``t`` tables is the product of the new-table
weights (strength + discount * tables, which grows with each table), of the parent's probabilities of its new
customers (which it remembers as they come), and of the generalised Stirling number that counts the seatings of the
customers at ``t`` tables. Parents are seated in the same way against the base. Dishes of one half of a class are drawn
together, given the tables of all others. Predictive probabilities are averaged over the draws.

Words meet in a shuffle by word, pairs of words in a shuffle by class; answers go back to the blocks (see ``words``).
Nothing is collected: the corpus totals are one row, joined to the blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

FOLDS = 10
#: Sweeps over a class, and how many of the last ones count.
SWEEPS, DRAWS = 4, 3
#: Discounts and strengths of contexts and of parents: constants of the model, the same for every corpus.
DISCOUNT, STRENGTH = 0.8, 1.0
PARENT_DISCOUNT, PARENT_STRENGTH = 0.7, 10.0
#: Training tokens for each class of contexts, and customers of a context before it is refined.
CLASS_TOKENS, REFINE = 1 << 20, 1 << 19
#: Customers up to which seatings are counted by their recursion; beyond it by closed forms.
EXACT = 1024
#: Customers up to which weights are plain products, which stay far from the ends of a double's range.
FEW = 12
#: Text bytes of a block; its tokens take several arrays of numbers.
BLOCK_BYTES = 7 << 20
#: Text bytes for each bucket of words that are numbered together.
BUCKET_BYTES = 16 << 20
START, UNKNOWN, FIRST = 0, 1, 2
END = b""
NUMBER, COUNT = 5, 7  # bytes of a word's number and of a count
WORDS, PAIRS = 1, 2
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])


def held_out(doc_id: int | None) -> bool:
    """Documents that the model doesn't learn from. A row without an id is a training row."""
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


def split(text: bytes) -> list[bytes]:
    return text.lower().split()


def _training(block: W.Block) -> np.ndarray:
    return ~np.array([held_out(i) for i in block.id_list()], dtype=bool)


# ---- words: counts and numbers ----


def _number(buckets: int):
    """Rows (bucket, word, block, number, n) sorted by bucket and word to answers: corpus count and number of each word.
    A bucket's words are numbered by falling count; a row without a block holds a bucket's tokens and distinct words."""

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        bucket = table.column("bucket")[0].as_py()
        words = pc.run_end_encode(table.column("word").chunk(0))
        ends = words.run_ends.to_numpy()
        starts = np.append(0, ends[:-1])
        total = np.add.reduceat(table.column("n").to_numpy(), starts)
        rank = np.empty(len(total), dtype=np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(len(total))
        number = np.where(total > 0, FIRST + rank * buckets + bucket, UNKNOWN)
        place, block, local = np.repeat(np.arange(len(total)), ends - starts), table.column("block").to_numpy(), table.column("number").to_numpy()

        def data(at: np.ndarray) -> bytes:
            return np.int64(len(at)).tobytes() + W.planes(local[at]) + W.planes(total[place[at]], COUNT) + W.planes(number[place[at]], NUMBER)

        yield W.by_block(block, data, WORDS, bucket)
        totals = np.array([total.sum(), (total > 0).sum()], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([None], type=pa.int64()), pa.array([WORDS], type=pa.int32()), pa.array([bucket], type=pa.int32()), pa.array([totals.tobytes()], type=pa.binary())], names=["block", "kind", "part", "data"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            edges = [0, *(np.flatnonzero(np.diff(batch.column(0).to_numpy())) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:], strict=False):
                if held and held[-1].column(0)[0] != batch.column(0)[a]:
                    yield from answer(held)
                    held = []
                if b > a:
                    held.append(batch.slice(a, b - a))
        if held:
            yield from answer(held)

    return number


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [np.frombuffer(d, dtype=np.int64).tolist() for b, d in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True) if b is None]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], type=pa.int64()) for k in (0, 1)], names=["tokens", "distinct"])


# ---- a block's tokens and pairs ----


class Tokens:
    """A block's tokens as pairs of context and word, and the distinct pairs by class of the context."""

    def __init__(self, block: W.Block, answers: W.Answers):
        self.block = block
        words = [*block.words, END]
        n = len(words)
        self.corpus, self.n_distinct = int(block.row["tokens"]), int(block.row["distinct"])
        total, number = np.zeros(n, dtype=np.int64), np.full(n, UNKNOWN)
        for kind, _, raw in answers:
            if kind == WORDS:
                r = W.Reader(raw)
                (m,) = r.head("<q")
                at = r.numbers(m)
                total[at], number[at] = r.numbers(m, COUNT), r.numbers(m, NUMBER)
        self.training = _training(block)
        sizes = block.sizes
        ends = np.cumsum(sizes + 1) - 1
        self.doc = np.repeat(np.arange(len(sizes)), sizes + 1)
        local = np.full(len(self.doc), n - 1, dtype=np.int64)
        inner = np.ones(len(local), dtype=bool)
        inner[ends] = False
        local[inner] = block.numbers
        self.seen = total[local]  # in training, over the corpus
        # contexts: the word before, and the word before that where the context is refined
        before = np.append(n, local[:-1])
        before[ends - sizes] = n  # a text's start
        further = np.append(n, before[:-1])
        further[ends - sizes] = n
        customers = np.append(total, total[n - 1])  # a start for each end
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, [*words, b"\nstart"]), dtype=np.uint64, count=n + 1)
        hashes = (hashes >> np.uint64(2)).astype(np.int64)
        # places of contexts: the word before has its local number, a refined one a place after those for each part
        context, key, klass = before.copy(), np.append(number, START) << 20, hashes
        hot = np.flatnonzero(customers[before] > REFINE)
        if len(hot):
            sub = hashes[further[hot]] % -(-customers[before[hot]] // REFINE)
            both, back = np.unique(before[hot] << 20 | sub, return_inverse=True)
            context[hot] = n + 1 + back
            old, sub = both >> 20, both & ((1 << 20) - 1)
            key, klass = np.append(key, key[old] | sub), np.append(klass, hashes[old] ^ (sub * 0x9E3779B97F4A7 & ((1 << 62) - 1)))
        known = (customers[before] > 0) & (self.corpus > 0)
        n_classes = max(1, -(-self.corpus // CLASS_TOKENS))
        self._pairs(np.flatnonzero(known), context, key, klass % n_classes, local, number, total)

    def _pairs(self, at: np.ndarray, context: np.ndarray, key: np.ndarray, klass: np.ndarray, local: np.ndarray, number: np.ndarray, total: np.ndarray) -> None:
        """Distinct pairs, from one sort: contexts get places by class and key, words by number."""
        there = np.flatnonzero(np.bincount(context[at], minlength=len(key)))
        there = there[np.lexsort((key[there], klass[there]))]
        place = np.empty(len(key), dtype=np.int64)
        place[there] = np.arange(len(there))
        self.contexts, self.klass = key[there], klass[there]
        self.words, first, word = np.unique(number, return_index=True, return_inverse=True)  # all unknown words are one
        self.word_count = total[first]
        width = len(self.words)
        pairs = place[context[at]] * width + word[local[at]]
        order = np.argsort(pairs)
        pairs = pairs[order]
        head = np.diff(pairs, prepend=-1) > 0
        of_token = np.empty(len(pairs), dtype=np.int64)
        of_token[order] = np.cumsum(head) - 1
        pairs = pairs[head]
        self.pair_context, self.pair_word = pairs // width, pairs % width
        self.pair_count = np.bincount(of_token[self.training[self.doc[at]]], minlength=len(pairs))
        self.pair = np.full(len(local), -1)
        self.pair[at] = of_token
        edges = np.flatnonzero(np.diff(self.klass, prepend=-1))
        self.classes = self.klass[edges]
        self.context_cuts = np.append(edges, len(self.klass))
        self.pair_cuts = np.searchsorted(self.pair_context, self.context_cuts)

    def requests(self) -> Iterator[tuple[int, bytes]]:
        """(class, data) for each class that the block has contexts of."""
        for k, klass in enumerate(self.classes.tolist()):
            (a, b), (x, y) = self.context_cuts[k : k + 2], self.pair_cuts[k : k + 2]
            words, index = np.unique(self.pair_word[x:y], return_inverse=True)
            head = np.array([self.corpus, self.n_distinct, b - a, len(words), y - x], dtype=np.int64).tobytes()
            sizes = np.bincount(self.pair_context[x:y] - a, minlength=b - a)
            yield klass, head + W.planes(np.diff(self.contexts[a:b], prepend=0), 8) + W.planes(sizes) + W.planes(np.diff(self.words[words], prepend=0), NUMBER) + W.planes(self.word_count[words], COUNT) + W.planes(index) + W.planes(self.pair_count[x:y], COUNT)

    def base(self) -> np.ndarray:
        """Base probability of each token."""
        return base(self.seen, self.corpus, self.n_distinct)

    def probabilities(self, answers: W.Answers) -> np.ndarray:
        """The model's probability of each token; after a context that training lacks, the base's."""
        p = np.zeros(len(self.pair_word))
        place = {k: i for i, k in enumerate(self.classes.tolist())}
        for kind, part, raw in answers:
            if kind == PAIRS:
                x, y = self.pair_cuts[place[part] : place[part] + 2]
                p[x:y] = np.frombuffer(raw, dtype=np.float32)
        out = self.base()
        hit = self.pair >= 0
        out[hit] = p[self.pair[hit]]
        return out


def base(count: np.ndarray, n_tokens: int, n_distinct: int) -> np.ndarray:
    return (count + 0.1) / (n_tokens + 0.1 * (n_distinct + 1))


# ---- seatings ----


@lru_cache(maxsize=4)
def log_seatings(d: float, n: int = EXACT) -> np.ndarray:
    """log of the generalised Stirling numbers S(c, t), c and t up to n: the weight of all seatings of c customers at t
    tables, each table of k customers weighing (1 - d)(2 - d)...(k - 1 - d)."""
    out = np.full((n + 1, n + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(n + 1)
    for c in range(n):
        with np.errstate(divide="ignore"):
            stay = out[c] + np.log(np.maximum(c - d * t, 0))
        out[c + 1, 0] = -np.inf
        out[c + 1, 1:] = np.logaddexp(stay[1:], out[c, :-1])
    return out


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, after ten steps up."""
    x = np.asarray(x, dtype=float)
    down = np.log(np.multiply.reduce([x + i for i in range(10)]))
    z = x + 10
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - down


def log_seatings_far(c: float, t: np.ndarray, d: float) -> np.ndarray:
    """The same for many customers, c > t: few tables by the closed alternating sum, which then hardly cancels, more by
    the saddle point of the series sum over c of S(c, t) x^c / c!."""
    t = np.asarray(t, dtype=float)
    few = t <= c**d
    out = np.empty(len(t))
    out[few], out[~few] = _alternating(c, t[few], d), _saddle(c, t[~few], d)
    return out


def _alternating(c: float, t: np.ndarray, d: float) -> np.ndarray:
    j = np.arange(1, 61)
    ways = np.where(j <= t[:, None], log_gamma(t + 1)[:, None] - log_gamma(np.maximum(t[:, None] - j, 0) + 1.0) - log_gamma(j + 1.0), -np.inf)
    size = ways + log_gamma(c - j * d) - log_gamma(np.array(c - d)) + log_gamma(1 + j * d)
    total = ((-1.0) ** (j + 1) * np.sin(np.pi * j * d) / np.pi * np.exp(size)).sum(axis=1)
    return log_gamma(np.array(c - d)) - t * np.log(d) - log_gamma(t + 1) + np.log(np.maximum(total, 1e-300))


def _saddle(c: float, t: np.ndarray, d: float) -> np.ndarray:
    # log(1 - x) by Newton's steps: log of x g'(x) / g(x) falls and is convex, its slope is between d - 1 and half of that,
    # and the first point is left of where it is log(c / t), so the steps come near from the left, each squaring the rest
    want = np.log(c / t)
    low = (want - np.log(d)) / (d - 1)
    for _ in range(8):
        one, all_ = -np.expm1(low), -np.expm1(d * low)
        above = np.log(one / all_) + np.log(d) + (d - 1) * low - want
        low = low - above / (d - 1 - (1 - one) / one + d * (1 - all_) / all_)
    y = np.exp(low)
    x, g = -np.expm1(low), -np.expm1(d * low)
    g1, g2 = d * y ** (d - 1), d * (1 - d) * y ** (d - 2)
    spread = t * x * ((g1 + x * g2) / g - x * (g1 / g) ** 2)
    return log_gamma(c + 1.0) - t * np.log(d) - log_gamma(t + 1.0) + t * np.log(g) - c * np.log(x) - 0.5 * np.log(2 * np.pi * spread)


def draw_tables(c: np.ndarray, open_weight: np.ndarray, d: float, p, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with ``c`` customers, from their conditional given all else. ``open_weight``: strength and
    discount times the restaurant's other tables. ``p(rows, i)``: probability, in the parent, of the i-th new customer."""
    out = np.minimum(c, 1)
    order = np.argsort(c, kind="stable")
    order = order[c[order] >= 2]
    near = order[c[order] <= EXACT]
    table = log_seatings(d)
    few = np.exp(table[: FEW + 1, : FEW + 1])
    edges = [0, *(np.flatnonzero(np.diff(c[near])) + 1).tolist(), len(near)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b == a:
            continue
        n = int(c[near[a]])
        i = np.arange(n)
        step = max(1, (1 << 19) // n)
        for at in range(a, b, step):
            rows = near[at : min(b, at + step)]
            if n <= FEW:  # the first factor is the same for all numbers of tables
                weight = np.empty((n, len(rows)))
                weight[0] = 1.0
                np.cumprod(((open_weight[rows, None] + d * i[1:]) * p(rows, i[None, 1:])).T, axis=0, out=weight[1:])
                out[rows] = 1 + _pick_product(weight * few[n, 1 : n + 1, None], rng)
                continue
            weight = np.cumsum(np.log((open_weight[rows, None] + d * i) * p(rows, i[None, :])), axis=1) + table[n, 1 : n + 1]
            out[rows] = 1 + _pick(weight, rng)
    for row in order[c[order] > EXACT]:
        out[row] = _far_tables(int(c[row]), row, open_weight[row], d, p, rng)
    return out


def _pick(weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One column of each row, in proportion to exp(weight)."""
    total = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
    return (total < rng.random(len(weight))[:, None] * total[:, -1:]).sum(axis=1)


def _pick_product(weight: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """One row of each column, in proportion to its weight."""
    total = np.cumsum(weight, axis=0)
    return (total < rng.random(weight.shape[1]) * total[-1]).sum(axis=0)


def _far_tables(c: int, row: int, open_weight: float, d: float, p, rng: np.random.Generator) -> int:
    """Tables of one dish with many customers: the same weights, on points that close in on where the mass lies."""
    rows = np.array([row])

    def weight(t: np.ndarray) -> np.ndarray:
        # sums of log(a + i) for i < t, from values at the ends: p changes by steps of one customer
        first, last = p(rows, np.zeros((1, 1)))[0, 0], p(rows, t[None, :] - 1.0)[0]
        return t * np.log(d) + log_gamma(open_weight / d + t) - log_gamma(open_weight / d) + t * (np.log(first) + np.log(last)) / 2 + log_seatings_far(float(c), t, d)

    points = np.unique(np.round(np.geomspace(1, c - 1, 49)))
    for _ in range(3):
        w = weight(points)
        near = np.flatnonzero(w > w.max() - 30)
        a, b = points[max(0, near[0] - 1)], points[min(len(points) - 1, near[-1] + 1)]
        points = np.unique(np.round(np.linspace(a, b, 65)))
    w = weight(points)
    k = int(_pick(w[None, :], rng)[0])
    width = int(points[min(k + 1, len(points) - 1)] - points[k])
    return int(points[k]) + int(rng.integers(0, max(1, width)))


class Seating:
    """A class of contexts and their parent: tables of every (context, word) and of every word in the parent."""

    def __init__(self, context: np.ndarray, word: np.ndarray, customers: np.ndarray, base: np.ndarray, n_contexts: int, seed: int):
        self.context, self.word, self.c, self.base, self.n = context, word, customers, base, n_contexts
        self.rng = np.random.default_rng(seed)
        self.t = np.minimum(customers, 1)
        self.customers = np.bincount(context, customers, n_contexts)
        self.m = np.bincount(word, self.t, len(base)).astype(np.int64)
        self.s = np.minimum(self.m, 1)

    def _contexts(self, rows: np.ndarray) -> None:
        word, own = self.word[rows], self.t[rows]
        tables = np.bincount(self.context, self.t, self.n)[self.context[rows]]
        m, s = self.m[word] - own, self.s[word]
        new = (PARENT_STRENGTH + PARENT_DISCOUNT * self.s.sum()) * self.base[word]
        below = PARENT_STRENGTH + self.m.sum() - own

        def p(at, i):
            k = m[at, None] + i
            return (np.maximum(k - PARENT_DISCOUNT * np.minimum(s[at, None], k), 0) + new[at, None]) / (below[at, None] + i)

        drawn = draw_tables(self.c[rows], STRENGTH + DISCOUNT * (tables - own), DISCOUNT, p, self.rng)
        self.t[rows] = drawn
        self.m = np.bincount(self.word, self.t, len(self.base)).astype(np.int64)
        self.s = np.minimum(np.maximum(self.s, np.minimum(self.m, 1)), self.m)

    def _parent(self, rows: np.ndarray) -> None:
        others = self.s.sum() - self.s[rows]
        self.s[rows] = draw_tables(self.m[rows], PARENT_STRENGTH + PARENT_DISCOUNT * others, PARENT_DISCOUNT, lambda at, i: self.base[rows[at], None] + 0 * i, self.rng)

    def sweep(self) -> None:
        for kind, counts in ((self._contexts, self.c), (self._parent, None)):
            several = np.flatnonzero((self.m if counts is None else counts) > 1)
            side = self.rng.random(len(several)) < 0.5
            for rows in (several[side], several[~side]):
                if len(rows):
                    kind(rows)

    def predictive(self, context: np.ndarray, word: np.ndarray, pair: np.ndarray) -> np.ndarray:
        """Probability of words after contexts; ``pair``: the seated pair, or -1."""
        tables = np.bincount(self.context, self.t, self.n)
        parent = (self.m - PARENT_DISCOUNT * self.s + (PARENT_STRENGTH + PARENT_DISCOUNT * self.s.sum()) * self.base) / (PARENT_STRENGTH + self.m.sum())
        own = np.where(pair >= 0, (self.c - DISCOUNT * self.t)[pair], 0.0) if len(self.c) else np.zeros(len(pair))
        return (own + (STRENGTH + DISCOUNT * tables[context]) * parent[word]) / (STRENGTH + self.customers[context])


def averaged(context, word, customers, base, n_contexts: int, seed: int, sweeps: int = SWEEPS, draws: int = DRAWS) -> np.ndarray:
    """Predictive probability of each (context, word), averaged over draws; pairs without customers are asked only."""
    seated = np.flatnonzero(customers > 0)
    pair = np.full(len(customers), -1)
    pair[seated] = np.arange(len(seated))
    room = Seating(context[seated], word[seated], customers[seated], base, n_contexts, seed)
    total = np.zeros(len(customers))
    for k in range(sweeps):
        room.sweep()
        if k >= sweeps - draws:
            total += room.predictive(context, word, pair)
    return total / draws


def _seat_class(table: pa.Table) -> pa.Table:
    """The requests of one class to answers: the probability of each requested pair."""
    rows = sorted(zip(table.column("block").to_pylist(), table.column("data").to_pylist(), strict=True))
    klass = table.column("part")[0].as_py()
    parts = []
    for _, squeezed in rows:
        r = W.Reader(W.unsqueeze(squeezed))
        corpus, distinct, n_contexts, n_words, n = r.array(5, "<i8").tolist()
        contexts, sizes = np.cumsum(r.numbers(n_contexts, 8)), r.numbers(n_contexts)
        words, seen = np.cumsum(r.numbers(n_words, NUMBER)), r.numbers(n_words, COUNT)
        parts.append((np.repeat(contexts, sizes), words[r.numbers(n)], r.numbers(n, COUNT), words, seen))
    every, context = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    words, first = np.unique(np.concatenate([p[3] for p in parts]), return_index=True)
    seen = np.concatenate([p[4] for p in parts])[first]
    word = np.searchsorted(words, np.concatenate([p[1] for p in parts]))
    keys, pair = np.unique(context * len(words) + word, return_inverse=True)
    customers = np.bincount(pair, np.concatenate([p[2] for p in parts]), len(keys)).astype(np.int64)
    p = averaged(keys // len(words), keys % len(words), customers, base(seen, corpus, distinct), len(every), klass)
    p, at, out = p.astype(np.float32)[pair], 0, []
    for x in parts:
        out.append(W.squeeze(p[at : at + len(x[0])].tobytes()))
        at += len(x[0])
    n = len(rows)
    return pa.table([pa.array([b for b, _ in rows], type=pa.int64()), pa.array([PAIRS] * n, type=pa.int32()), pa.array([klass] * n, type=pa.int32()), pa.array(out, type=pa.binary())], names=["block", "kind", "part", "data"])


def score(docs: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10).

    Null and empty texts are one token, the end. Rows without an id train the model and are not held out. Repeated
    rows count as often as they stand. With nothing to learn from, words are uniform over the one unknown word. After
    a word that training lacks, the score is the base's. An empty table gives no rows; other columns are not read.
    """
    size = W.text_bytes(docs)
    buckets = max(8, -(-size // BUCKET_BYTES))
    block_bytes = block_bytes or min(BLOCK_BYTES, W.block_size(docs, size))
    blocks = W.word_blocks(docs, split, block_bytes)
    rows = W.word_rows(blocks, _training, END).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
    dealt = rows.select("bucket", "word", "block", "number", "n").repartition("bucket").sortWithinPartitions("bucket", "word")
    words = dealt.mapInArrow(_number(buckets), W.ANSWER).repartition("block")
    totals = words.mapInArrow(_totals, "tokens long, distinct long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("distinct"))
    base_blocks = blocks.crossJoin(F.broadcast(totals))  # one row

    def requests(block: W.Block, answers: W.Answers) -> Iterator[pa.Table]:
        found = list(Tokens(block, answers).requests())
        yield pa.table([pa.array([k for k, _ in found], type=pa.int32()), pa.array([block.key] * len(found), type=pa.int64()), pa.array([W.squeeze(d) for _, d in found], type=pa.binary())], names=["part", "block", "data"])

    asked = W.meet(base_blocks, words, requests, "part int, block long, data binary", pa.schema([("part", pa.int32()), ("block", pa.int64()), ("data", pa.binary())]))
    pairs = asked.groupBy("part").applyInArrow(_seat_class, W.ANSWER)

    def rows_of(block: W.Block, answers: W.Answers) -> Iterator[pa.Table]:
        tokens = Tokens(block, answers)
        n = len(block.sizes)
        columns = [pa.array(block.id_list(), type=pa.int64()), pa.array(~tokens.training), pa.array(block.sizes + 1), pa.array(np.bincount(tokens.doc[tokens.seen > 0], minlength=n)), pa.array(np.full(n, tokens.corpus))]
        columns += [pa.array(np.bincount(tokens.doc, np.log10(np.maximum(p, 1e-300)), n)) for p in (tokens.base(), tokens.probabilities(answers))]
        yield pa.table(columns, names=_ARROW.names)

    return W.meet(base_blocks, words.unionByName(pairs), rows_of, SCHEMA, _ARROW)


def perplexity(scored: DataFrame) -> DataFrame:
    """Perplexity per token of held-out and of training documents, under the base and under the model."""
    per = {c: F.pow(10.0, -F.sum(c) / F.sum("n_tokens")).alias(p) for c, p in (("base_score", "base_perplexity"), ("score", "perplexity"))}
    return scored.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), *per.values())
