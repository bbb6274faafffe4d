"""Line labels and base rules: brute force, exhaustive decoding and held-out accuracy."""

import itertools
import random
import re

import numpy as np
import pytest

from medgraph.llm import quality

WORDS = "the of and to in that is was for with as on by at from this are be it an".split()


def _text(rng, good):
    lines = []
    for _ in range(rng.randint(3, 8)):
        n = rng.randint(8, 25)
        ws = [rng.choice(WORDS) + rng.choice(["", "ly", "ed", "ing"]) for _ in range(n)]
        lines.append(" ".join(ws).capitalize() + "." if good or rng.random() < 0.2 else " | ".join(ws))
    return "\n".join(lines)


@pytest.fixture(scope="module")
def labelled():
    rng = random.Random(4)
    return [(i, _text(rng, i % 4 != 0), int(i % 4 != 0)) for i in range(400)]


@pytest.fixture(scope="module")
def tables(spark, labelled):
    docs = spark.createDataFrame([(i, t, 0) for i, t, _ in labelled], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in labelled if i % 3] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def _base(t):
    ws = re.findall("[^\x20\x09-\x0d]+", t or "")
    seen, dup, places = set(), 0, {}
    for line in (t or "").split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    for i in range(len(ws) - 7):
        places.setdefault(tuple(ws[i : i + 8]), []).append(i)
    cover = {k for v in places.values() if len(v) > 1 for i in v for k in range(i, i + 8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover), len(ws) < 20 or 100 * len(cover) > 30 * len(ws)


def test_base_figures(spark):
    odd = [None, "", " \n\t\x0b", "a b c", "x\x1cy \x85 é# |<>", "l1 a\nl1 a\n \nl1 a", "w " * 40, " ".join(str(i % 9) for i in range(60)), "z\n" * 30, "The end. " * 3000, "same", "same"]
    docs = spark.createDataFrame(list(enumerate(odd)) + [(None, "no id")], "doc_id long, text string")
    field = quality.fit([])
    got = {r.doc_id: r for r in quality.judge(docs, None, field).collect()}
    assert len(got) == len(odd) + 1
    for i, t in enumerate(odd):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == _base(t), t
        assert r.kept == (not r.base_failed)


def test_held_out_accuracy(tables, labelled):
    docs, labels = tables
    got = {r.doc_id: r.kept for r in quality.judge(docs, labels).collect()}
    held = [(i, q) for i, t, q in labelled if i % 3 == 0 and not _base(t)[5]]
    assert sum(got[i] == bool(q) for i, q in held) >= 0.97 * len(held)


def test_viterbi_finds_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(50):
        field = quality.Field(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2), 0.5)
        e = rng.normal(size=rng.integers(1, 7)).tolist()

        def value(p, field=field, e=e):
            return field.start[p[0]] + sum(x for x, s in zip(e, p, strict=True) if s) + sum(field.transitions[a, b] for a, b in itertools.pairwise(p))

        best = max(itertools.product((0, 1), repeat=len(e)), key=value)
        assert np.isclose(value(field.viterbi(e)), value(best))


def test_keep_good_returns_the_columns(tables):
    docs, labels = tables
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema
    marks = {r.doc_id for r in quality.judge(docs, labels).filter("kept").collect()}
    assert {r.doc_id for r in kept.collect()} == marks


def test_empty_and_unlabelled(spark, tables):
    docs, labels = tables
    assert quality.judge(docs.limit(0), labels).count() == 0
    none = quality.judge(docs, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
