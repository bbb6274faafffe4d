"""The pattern grammar by cases, and held-out accuracy of the learned scorer."""

import random
import zlib

import pytest

from medgraph.llm import toxicity as tox

SEEDS = tox.seed_lexicon()


def _patterns(text):
    low, found = text.lower(), tox.hits(text.lower(), SEEDS)
    classes = [found[m.start()][0] if m.start() in found else tox._cues().get(m.group(), "other") for m in tox._WORD.finditer(low)]
    return [(kind, flags, round(factor, 3)) for kind, flags, factor in filter(None, tox.matches(classes))]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("what an idiot", [("insult", tox.BOUND, 1.0)]),
        ("you are an idiot", [("insult", tox.AIMED | tox.BOUND, 1.25)]),
        ("an idiot you are", [("insult", tox.AIMED | tox.BOUND, 1.25)]),
        ("one idiot beside you", [("insult", tox.AIMED, 1.25)]),
        ("that is not stupid", [("insult", tox.NEGATED | tox.BOUND, 0.5)]),
        ("the paper said he was a loser", [("insult", tox.REPORTED | tox.AIMED | tox.BOUND, 0.875)]),
        ("I will kill you", [("threat", tox.AIMED | tox.BOUND, 1.875)]),
        ("you kill him", [("threat", tox.AIMED, 0.938)]),
        ("a kill", []),
        ("he never said I will hurt you", [("threat", tox.NEGATED | tox.REPORTED | tox.AIMED | tox.BOUND, 0.656)]),
        ("not one two three four five stupid", []),
        ("idiot came late", []),
        ("idiot came with one moron", [("insult", tox.BOUND, 1.0), ("insult", tox.BOUND, 1.25)]),
        ("skilled idiotic trashy", []),
    ],
)
def test_grammar(text, want):
    assert _patterns(text) == want


def test_scopes_reach_through_a_whole_clause_of_any_length():
    long = "you " + "supercalifragilistic" * 300 + " idiot"
    assert tox.figures(long, SEEDS)[tox.AIMED] > 0  # an aimed insult, over 6,000 characters away
    one, two = tox.figures("idiot " * 5000, SEEDS), tox.figures("idiot. " * 5000, SEEDS)
    assert one[tox.BOUND] == pytest.approx(0.6931, abs=1e-3) and two[tox.BOUND] == pytest.approx(8.517, abs=1e-2)  # clauses, not words


def test_a_word_alone_has_no_figure():
    calm = tox.figures("some words here. " * 9, SEEDS)[:-1]
    for text in ("one idiot came. " + "some words here. " * 8, "idiot"):
        assert not tox.figures(text, SEEDS)[:-1].any() and not calm.any()
    near, far = ("some idiot came. " + "calm. " * n + "any moron left." for n in (tox.TIRADE - 1, tox.TIRADE))
    assert tox.figures(near, SEEDS)[tox.BOUND] > 0 and not tox.figures(far, SEEDS)[:-1].any()


def _walk(classes):
    """The patterns by looking around every word, without machines: (kind, flags) of each match."""
    out = []

    def after(i, kinds, reach):
        return any(classes[j] in kinds for j in range(max(0, i - reach), i))

    for i, c in enumerate(classes):
        if c not in ("insult", "learned", "harm"):
            continue
        insults, flags = ("insult", "learned"), 0
        ahead = range(i + 1, min(len(classes), i + 1 + 40))
        if c == "harm":
            flags |= tox.BOUND * after(i, ("intent",), 4)
        else:
            flags |= tox.BOUND * (after(i, ("binder",), 3) or after(i, insults, 40) or any(classes[j] in insults for j in ahead))
        flags |= tox.AIMED * (after(i, ("target",), 6) or any(classes[j] == "target" for j in ahead[:6]))
        flags |= tox.NEGATED * after(i, ("negation",), 4) | tox.REPORTED * after(i, ("speech", "quote"), 40)
        if flags:
            out.append(("threat" if c == "harm" else c, flags))
    return out


def test_machines_against_a_walk():
    rng = random.Random(9)
    for n in [0, 1, 2, 5, 9, 30, 120] * 60:
        classes = [rng.choice(tox.CLASSES) if rng.random() < 0.2 else "other" for _ in range(n)]
        assert [m[:2] for m in filter(None, tox.matches(classes))] == _walk(classes)


def test_composition_is_a_product():
    letters = ("a", "b")
    flip = tox.machine(letters, 1, lambda q, s: (0, "b" if s == "a" else "a", 0.5))
    second = tox.machine(letters, 2, lambda q, s: (1 - q, s if q else "a", 2.0))
    assert list(tox.compose(flip, second).run("aab")) == [("a", 1.0), ("b", 1.0), ("a", 1.0)]


def _tables(spark):
    rng = random.Random(7)
    words = [a + b for a in "ba ko li mu ne".split() for b in "ra si to vu ze".split()]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 5 == 1 or i % 7 == 0
        ws = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        if toxic:
            for _ in range(3):
                ws.insert(rng.randrange(len(ws)), rng.choice(["zlurg", "zlurgen", "zlurgo"]))
        rows.append((i, " ".join(ws) + ".", "xx", float(i)))
        labels.append((i, int(toxic)))
    rows += [(None, None, None, None), (5000, "", "", 0.0), (5001, "long text " * 30_000, "", 0.0), (5001, "you idiot", "", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, toxic string, score double"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(spark):
    docs, labels = _tables(spark)
    got = tox.score(docs, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_without_labels_and_without_rows(spark):
    docs, labels = _tables(spark)
    few = spark.createDataFrame([(1, "you idiot, you moron"), (2, "a fine day")], "doc_id long, text string")
    assert {r.doc_id: r.predicted for r in tox.score(few, labels.limit(0)).collect()} == {1: 1, 2: 0}
    assert tox.score(docs.limit(0), labels).count() == 0
