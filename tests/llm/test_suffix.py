"""Repeated 50-byte strings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from medgraph.llm import suffix


def _brute(rows):
    def key(i):
        return float("inf") if i is None else i

    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(key(i), first.get(b[p : p + 50], key(i)))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def _rows(seed):
    rng = random.Random(seed)
    words = "the of and alpha beta é gamma delta".split()
    base = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(10)]
    rows = []
    for i in range(150):
        parts = [rng.choice(base) if rng.random() < 0.4 else " ".join(rng.choice(words) + str(rng.randint(0, 9)) for _ in range(20)) for _ in range(rng.randint(0, 4))]
        t = "|".join(parts)
        if rng.random() < 0.3 and t:
            k = rng.randrange(len(t))
            t = t[:k] + t[k + 5 :]
        rows.append((rng.choice([i, i, i, i - 1, None]), t))
    odd = ["a" * 300, "a" * 120 + "b" * 80, "ab" * 100, "b" * 70, None, "", "x" * 49, "\0" * 80, "é" * 60, "abc" * 9000]
    return rows + [(500 + i, t) for i, t in enumerate(odd)] + [(3, "\0" * 60), (4, "é" * 40)] + [(600, base[0])] * 3


@pytest.mark.parametrize(("seed", "chunk", "block_bytes"), [(1, 257, 2000), (2, suffix.CHUNK, suffix.B.BLOCK_BYTES)])
def test_against_brute_force(spark, monkeypatch, seed, chunk, block_bytes):
    monkeypatch.setattr(suffix, "CHUNK", chunk)
    rows = _rows(seed)
    docs = spark.createDataFrame([(i, t, 1, "s", 2) for i, t in rows], "doc_id long, text string, block int, data string, kind int")
    got = suffix.repeat_digests(docs, block_bytes).collect()
    assert sorted(map(tuple, got), key=str) == sorted(_brute(rows), key=str)


def test_remove_repeats_keeps_columns_and_rows(spark):
    passage = "é" + "a long passage that stands in two documents, word for word "
    docs = spark.createDataFrame([(1, "x", passage + "1", 0), (2, "y", "head " + passage, 0), (3, "z", None, 7), (3, "z", None, 7)], "doc_id long, source string, text string, n_chars long")
    got = suffix.remove_repeats(docs)
    assert got.columns == docs.columns
    rows = sorted((tuple(r) for r in got.collect()), key=str)
    assert rows == [(1, "x", passage + "1", 0), (2, "y", "head ", 5), (3, "z", None, 7), (3, "z", None, 7)]


def test_empty_table(spark):
    assert suffix.repeat_digests(spark.createDataFrame([], "doc_id long, text string")).count() == 0
