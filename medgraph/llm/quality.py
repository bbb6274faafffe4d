"""Quality rules by labelling lines: a linear-chain conditional random field marks each line content or boilerplate.

Viterbi decoding gives every document's best line labels, and the share of its words that stand in content lines
decides whether it stays. Base rules (too few words, too much repetition) come first.

The field is trained here on a bounded sample of documents with a quality label. Lines have no labels of their own, so
they start with their document's, a line classifier (the field without its transitions) relabels the lines of poor
documents, and the field is fitted to the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_docs

#: Labelled documents that the field is fitted on, and lines of each. A bounded sample, chosen by a hash of doc_id.
SAMPLE_DOCS = 2000
SAMPLE_LINES = 300
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
REPEAT_WINDOW = 8

#: Upper edges of the bins of each figure of a line. Fixed values.
BINS = {
    "words": (1, 3, 8, 20, 60),
    "symbols per word": (0.02, 0.2, 0.6, 1.5),
    "bars per word": (0.05, 0.2, 0.4),
    "capitals per letter": (0.12, 0.4, 0.8),
    "exclamations per word": (0.05, 0.5),
    "digits per byte": (0.02, 0.15, 0.4),
    "bytes per word": (3.0, 4.5, 6.5, 9.0),
    "stops per word": (0.02, 0.08, 0.2),
    "words like the one before": (0.05, 0.3),
}
#: Yes-or-no figures of a line.
FLAGS = ("ends a sentence", "starts with a capital", "equals an earlier line", "first line", "last line", "link or mark-up")
_EDGES = [np.array(x) for x in BINS.values()]
_OFFSETS = np.cumsum([0] + [len(x) + 1 for x in _EDGES])
N_FEATURES = int(_OFFSETS[-1]) + len(FLAGS)
_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_UPPER, _LOWER, _DIGITS = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_ENDS = (b".", b"!", b"?", b".\"", b":", b";")


def _count(b: bytes, chars: bytes) -> int:
    return len(b) - len(b.translate(None, chars))


def line_features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Active features of each line with a word (one row of numbers each), words of each, and repeated lines."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    numbers, flags, seen, repeated = [], [], set(), 0
    for k, line in enumerate(lines):
        ws = line.split()
        if not ws:
            continue
        n, upper, body = len(ws), _count(line, _UPPER), len(line)
        letters = upper + _count(line, _LOWER) or 1
        again = line in seen
        repeated += again
        seen.add(line)
        numbers.append((n, _count(line, _SYMBOLS) / n, ws.count(b"|") / n, upper / letters, line.count(b"!") / n, _count(line, _DIGITS) / body, body / n, (line.count(b". ") + line.count(b", ")) / n, sum(map(eq, ws, ws[1:])) / n))
        flags.append((line.rstrip().endswith(_ENDS), ws[0][:1].isupper() or ws[0][:1] > b"\x7f", again, k == 0, k == len(lines) - 1, b"http" in line or b"</" in line))
    if not numbers:
        return np.zeros((0, len(_EDGES) + len(FLAGS)), dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    table = np.array(numbers)
    binned = [np.searchsorted(edges, table[:, j], side="left") + _OFFSETS[j] for j, edges in enumerate(_EDGES)]
    marked = np.where(np.array(flags), np.arange(len(FLAGS)) + _OFFSETS[-1], -1)
    return np.column_stack([*binned, marked]), table[:, 0].astype(np.int64), repeated


@dataclass
class Field:
    """Weights of a two-state chain; state 1 is content. ``weights`` favour content; a last 0 stands for absent flags."""

    weights: np.ndarray
    transitions: np.ndarray
    start: np.ndarray
    threshold: float

    def viterbi(self, emissions: list[float]) -> list[int]:
        (t00, t01), (t10, t11) = self.transitions.tolist()
        s0, s1 = self.start.tolist()
        s1 += emissions[0]
        back = []
        for e in emissions[1:]:
            a, b, c, d = s0 + t00, s1 + t10, s0 + t01, s1 + t11
            back.append((b > a, d >= c))
            s0, s1 = max(a, b), max(c, d) + e
        state = int(s1 >= s0)
        path = [state]
        for pair in reversed(back):
            state = int(pair[state])
            path.append(state)
        return path[::-1]

    def content_share(self, features: np.ndarray, words: np.ndarray) -> float:
        """Share of words in lines that the best path marks content; 1 for a text without lines."""
        if not len(words):
            return 1.0
        path = self.viterbi(self.weights[features].sum(axis=1).tolist())
        return float(words[np.array(path) == 1].sum() / words.sum())


def _logistic(x: list[np.ndarray], y: list[np.ndarray], steps: int = 150) -> np.ndarray:
    rows, target = np.concatenate(x), np.concatenate(y)
    w = np.zeros(N_FEATURES + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    balance = np.where(target == 1, 0.5 / max(1, (target == 1).sum()), 0.5 / max(1, (target == 0).sum()))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-w[rows].sum(axis=1)))
        g = np.bincount((rows % (N_FEATURES + 1)).ravel(), np.repeat(balance * (p - target), rows.shape[1]), N_FEATURES + 1) + 1e-4 * w
        _adam(w, g, m, v, t, 0.1)
        w[-1] = 0
    return w


def _adam(w, g, m, v, t, rate) -> None:
    m += 0.1 * (g - m)
    v += 0.001 * (g * g - v)
    w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fit_chain(x: list[np.ndarray], y: list[np.ndarray], weights: np.ndarray, steps: int = 60) -> Field:
    """Maximum likelihood of line labels by forward-backward over all chains at once, padded to the longest."""
    order = np.argsort([-len(r) for r in x])
    x, y = [x[i] for i in order], [y[i] for i in order]
    lengths = np.array([len(r) for r in x])
    long, n = lengths[0], len(x)
    rows = np.full((n, long, x[0].shape[1]), -1)
    label = np.zeros((n, long), dtype=np.int64)
    for i, (r, lab) in enumerate(zip(x, y, strict=True)):
        rows[i, : len(r)], label[i, : len(lab)] = r, lab
    inside = np.arange(long)[None] < lengths[:, None]
    live = [int((lengths > t).sum()) for t in range(long)]
    w, trans, start = weights.copy(), np.zeros((2, 2)), np.zeros(2)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, trans, start)]
    seen_pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            seen_pairs[a, b] = ((label[:, :-1] == a) & (label[:, 1:] == b) & inside[:, 1:]).sum()
    total = inside.sum()
    for step in range(1, steps + 1):
        e = np.zeros((n, long, 2))
        e[..., 1] = w[rows].sum(axis=2) * inside
        alpha = np.zeros((n, long, 2))
        beta = np.zeros((n, long, 2))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, long):
            k = live[t]
            alpha[:k, t] = e[:k, t] + np.logaddexp(alpha[:k, t - 1, 0, None] + trans[0], alpha[:k, t - 1, 1, None] + trans[1])
        for t in range(long - 2, -1, -1):
            k = live[t + 1]
            ahead = e[:k, t + 1] + beta[:k, t + 1]
            beta[:k, t] = np.logaddexp(trans[:, 0] + ahead[:, 0, None], trans[:, 1] + ahead[:, 1, None])
        z = np.logaddexp(*np.moveaxis(alpha[np.arange(n), lengths - 1], -1, 0))
        p1 = np.exp(np.minimum(0, alpha[..., 1] + beta[..., 1] - z[:, None])) * inside
        pairs = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                s = alpha[:, :-1, a] + trans[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None]
                pairs[a, b] = np.exp(np.minimum(0, s))[inside[:, 1:]].sum()
        miss = (p1 - label) * inside
        gw = np.bincount((rows % (N_FEATURES + 1)).ravel(), np.repeat(miss.ravel(), rows.shape[2]), N_FEATURES + 1) / total + 1e-4 * w
        first = p1[:, 0].sum() - label[:, 0].sum()
        for param, grad, (m, v), rate in zip((w, trans, start), (gw, (pairs - seen_pairs) / total + 1e-3 * trans, np.array([-first, first]) / total + 1e-3 * start), state, (0.05, 0.05, 0.05), strict=True):
            _adam(param, grad, m, v, step, rate)
        w[-1] = 0
    return Field(w, trans, start, 0.5)


def fit(sample: list[tuple[np.ndarray, np.ndarray, int]]) -> Field:
    """The field from (features, words, quality) of labelled documents. Without both kinds of label all lines count as
    content, so only the base rules reject."""
    sample = [s for s in sample if len(s[1])]
    if len({q for _, _, q in sample}) < 2:
        w = np.zeros(N_FEATURES + 1)
        return Field(w, np.zeros((2, 2)), np.array([0.0, 1.0]), 0.0)
    x = [f for f, _, _ in sample]
    y = [np.full(len(f), q) for f, _, q in sample]
    w = _logistic(x, y)
    y = [lab if q else (w[f].sum(axis=1) > 0).astype(np.int64) for f, lab, (_, _, q) in zip(x, y, sample, strict=True)]
    field = fit_chain(x, y, w)
    shares = np.array([field.content_share(f, n) for f, n, _ in sample])
    good = np.array([q for _, _, q in sample]) == 1
    cuts = np.linspace(0.2, 0.8, 25)
    right = [(shares[good] >= c).mean() + (shares[~good] < c).mean() for c in cuts]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-9)
    field.threshold = float(cuts[best[len(best) // 2]])
    return field


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Fit on at most ``sample_docs`` labelled documents. Their features, not their texts, come to the driver."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("quality")).filter("_id IS NOT NULL AND quality IN (0, 1)").orderBy(F.xxhash64("_id"), "quality").limit(sample_docs)
    rows = clean_docs(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "quality")

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t, q in zip(batch["text"], batch["quality"], strict=True):
                f, n, _ = line_features((t or "").encode())
                out.append((f[:SAMPLE_LINES].astype(np.int16).tobytes(), n[:SAMPLE_LINES].astype(np.int32).tobytes(), q))
            yield pd.DataFrame(out, columns=["f", "n", "q"])

    got = rows.mapInPandas(features, "f binary, n binary, q int").collect()
    wide = len(_EDGES) + len(FLAGS)
    found = [(np.frombuffer(r["f"], dtype=np.int16).reshape(-1, wide).astype(np.int64), np.frombuffer(r["n"], dtype=np.int32), r["q"]) for r in got]
    return fit(sorted(found, key=lambda s: (s[2], s[0].tobytes())))


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that stand in a window of ``window`` words found at least twice in the text, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    rolled = h[:n].copy()
    for k in range(1, window):
        rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    # equal hashes are only suspects: the words themselves decide
    starts = np.flatnonzero(np.concatenate(([False], same)) | np.concatenate((same, [False])))
    seen: dict[tuple, list[int]] = {}
    for at in order[starts].tolist():
        seen.setdefault(tuple(words[at : at + window]), []).append(at)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    for places in seen.values():
        if len(places) > 1:
            edge[places] += 1
            np.subtract.at(edge, np.array(places) + window, 1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def _score(field: Field):
    def one(text: str) -> tuple:
        raw = text.encode()
        words = raw.split()
        repeated = repeat_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEAT_PERCENT * len(words)
        features, sizes, dup = line_features(raw)
        share = field.content_share(features, sizes)
        return len(words), len(text) - _count(raw, _SPACE), _count(raw, _SYMBOLS), dup, repeated, failed, not failed and share >= field.threshold, share

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = list(zip(*(one(t or "") for t in part.column(1).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], names=_NAMES)

    return score


def judge(docs: DataFrame, labels: DataFrame, field: Field | None = None) -> DataFrame:
    """One row per row of ``docs`` with its figures, ``base_failed``, ``content_share`` and ``kept``.

    Null and empty texts have no words, so the base rules reject them. Lines without a word count for nothing. A very
    long text is one row. Repeated rows repeat; an empty table gives none; other columns are not read.
    """
    field = field or train(docs, labels)
    return clean_docs(docs).mapInArrow(_score(field), SCHEMA)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the documents that the rules reject, in one pass over each row: nothing is joined back."""
    field = train(docs, labels)
    kept = _score(field)

    def passes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [m for part in kept(iter([pa.RecordBatch.from_arrays([batch.column(at), batch.column(text)], names=["doc_id", "text"])])) for m in part.column(7).to_pylist()]
            yield batch.filter(pa.array(marks, type=pa.bool_()))

    at, text = docs.columns.index("doc_id"), docs.columns.index("text")
    return docs.mapInArrow(passes, docs.schema)
