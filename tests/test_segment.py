"""Words of Thai text against all ways to cut it, by both roads to the dictionary."""

import random

import pytest

from medgraph.operators import retrieve, segment

WORDS = ["อาการ", "ของ", "โรค", "ไข้", "เลือด", "ออก", "ไข้เลือดออก", "ตา", "ตาก", "กลม", "ลม"]


def _all_cuts(run, words):
    """(characters outside, tokens, lengths with the longest first) of every way to cut, the best one's tokens."""
    starts, best = segment._starts(run), None

    def go(i, cost, tokens, outside):
        nonlocal best
        if i == len(run):
            made = tokens + ([outside] if outside else [])
            key = (cost, len(made), [-len(t) for t in made])
            if best is None or key < best[0]:
                best = (key, made)
            return
        for j in range(i + 1, len(run) + 1):
            if not starts[j]:
                continue
            if run[i:j] in words:
                go(j, cost, tokens + ([outside] if outside else []) + [run[i:j]], "")
            if not any(starts[i + 1 : j]):
                go(j, cost + j - i, tokens, outside + run[i:j])

    go(0, 0, [], "")
    return best[1]


def test_best_path_against_all_cuts():
    rng = random.Random(4)
    for _ in range(300):
        run = "".join(rng.choice("กขาเ่ง") for _ in range(rng.randint(1, 9)))
        words = {"".join(rng.choice("กขาเ่ง") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))}
        got = segment.best_path(run, segment.trie(words))
        want = _all_cuts(run, words)
        assert "".join(got) == run
        # equal costs may be reached by different cuts where stretches outside tie; the costs are what is least
        cost = lambda tokens: (sum(len(t) for t in tokens if t not in words), len(tokens))
        assert cost(got) == cost(want), (run, words)


@pytest.mark.parametrize("limit", [segment.BROADCAST_BYTES, 0])
def test_segment(spark, limit):
    long = "ไข้เลือดออก" * 500
    rows = [(1, "อาการของโรคไข้เลือดออก"), (2, "Dose 2.5 MG ไข้xไข้ P-0042"), (3, None), (4, ""), (5, "โรคฉฉโรค"), (6, "ตากลม"), (7, long), (7, long), (8, "plain words only")]
    texts = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, piece string")
    words = spark.createDataFrame([(w,) for w in [*WORDS, "โรค", "", None]], "word string")
    got = {(r.id, r.piece): r.tokens for r in segment.segment(texts, words, broadcast_bytes=limit).collect()}
    assert got == {
        (1, "x"): ["อาการ", "ของ", "โรค", "ไข้เลือดออก"],
        (2, "x"): ["dose", "2.5", "mg", "ไข้", "x", "ไข้"],
        (3, "x"): None,
        (4, "x"): [],
        (5, "x"): ["โรค", "ฉฉ", "โรค"],
        (6, "x"): ["ตาก", "ลม"],
        (7, "x"): ["ไข้เลือดออก"] * 500,
        (8, "x"): ["plain", "words", "only"],
    }
    assert segment.segment(texts, words, broadcast_bytes=limit).count() == len(rows)


@pytest.mark.parametrize("limit", [segment.BROADCAST_BYTES, 0])
def test_empty_tables(spark, limit):
    texts = spark.createDataFrame([(1, "ไข้ 7")], "id long, text string")
    none = spark.createDataFrame([], "word string")
    assert [r.tokens for r in segment.segment(texts, none, broadcast_bytes=limit).collect()] == [["ไข้", "7"]]
    assert segment.segment(texts.limit(0), none, broadcast_bytes=limit).count() == 0


def test_terms_of_thai_questions(spark):
    questions = spark.createDataFrame([(1, "อาการของโรคไข้เลือดออก"), (2, "What is type 2 diabetes?"), (3, "ไข้ mg"), (4, None)], "question_id long, question string")
    words = spark.createDataFrame([(w,) for w in WORDS], "word string")
    got = retrieve.terms_of(questions, words, (*retrieve.STOPWORDS, "ของ")).collect()
    of = {i: {r.term for r in got if r.question_id == i} for i in (1, 2, 3, 4)}
    assert {"ไข้เลือดออก", "โรคไข้เลือดออก", "โรค ไข้เลือดออก", "อาการของโรค"} <= of[1]
    assert not any(t.startswith("ของ") for t in of[1])
    assert of[2] == {r.term for r in retrieve.terms_of(questions).collect() if r.question_id == 2}
    assert of[3] == {"ไข้", "ไข้ mg", "ไข้mg"} and not of[4]
