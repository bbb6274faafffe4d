"""Spelling variants against brute force over deletion neighbourhoods."""

import random
import re
import zlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from medgraph.llm import spelling
from medgraph.llm.queries import QUERIES

CLASH = "doc_id long, text string, word string, n long, key long, form string"


def _near(words):
    masks, near = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            masks[i, w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in masks.values():
        for w in group:
            near[w] |= group - {w}
    return near


def _brute(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 7 and c >= 2}
    near, form = _near(n), {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def _sorted(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(8)
    stems = ["Aspirine", "paracetamol", "ÉLÉVATION", "aaaaaaaaa", "abababab", "diagnosis", "treatment", "a×÷bcdefg"]

    def vary(w):
        i = rng.randrange(len(w))
        return rng.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("xyzÀ") + w[i + 1 :]])

    rows = [(i, " ".join(vary(rng.choice(stems)) for _ in range(rng.randint(0, 60)))) for i in range(250)]
    chain = [(1000 + k, " ".join([w] * c)) for k, (w, c) in enumerate([("qwertyuiop", 2500), ("qwertyuio", 220), ("qwertyui", 20), ("qwertyu", 2)])]
    rows += [*chain, (None, "nullword nullword"), (7, "nullwords"), (8, "nullwords"), (2000, None), (2001, ""), (2002, "longword " * 30_000), (2002, "longwords " * 9), rows[3], rows[3]]
    want = _brute(rows)
    got = _sorted(spelling.spelling_forms(spark.createDataFrame([(i, t, "w", 1, 2, "f") for i, t in rows], CLASH)))
    assert got == want
    assert any(r[2] != r[1] and r[1] for r in want)  # a form of a form


def test_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert _sorted(QUERIES["op13_spelling"](spark, folder)) == _brute(rows)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=7, max_size=12), st.integers(0, 11), st.sampled_from(["", "a", "b", "é"]), st.booleans(), st.data())
def test_near_words_meet_under_a_key(x, at, letter, insert, data):
    at = min(at, len(x) - 1)
    y = x[:at] + letter + x[at + (0 if insert else 1) :]
    if len(y) < 7 or x == y:
        return
    grams = sorted({w[i : i + 2] for w in (x, y) for i in range(len(w) - 1)})
    order = {g: i for i, g in enumerate(data.draw(st.permutations(grams)))}
    met = False
    for a, b in ((x, y), (y, x)):
        (_, pivots, end), (prefix, _, other) = spelling.prefix_and_pivots(a, order), spelling.prefix_and_pivots(b, order)
        assert pivots[1] - pivots[0] >= 2
        met |= end <= other and bool(spelling._edit_keys(a, pivots) & spelling._edit_keys(b, prefix))
    assert met
    mask = spelling._mask(x, order) ^ spelling._mask(y, order)
    assert (mask & 0xFFFFFFFF).bit_count() <= 2 and (mask >> 32).bit_count() <= 4


def test_empty_table(spark):
    assert spelling.spelling_forms(spark.createDataFrame([], CLASH)).collect() == []
