"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as word classes: what a lexicon of insults, verbs of harm and learned words holds (found by one
automaton over the text), and cues of intent, target, negation, reported speech, and of what binds a word into a phrase.
An insult transducer reads bound constructions (a determiner, copula or intensifier shortly before, or another insult
in the clause or in one near by) and a threat transducer an intent before a verb of harm; negation and reported-speech transducers
mark the matches in their scope, and a target transducer marks those near somebody. A last one lets pass what some
pattern holds, so that a word alone is no match. All are composed into one machine, whose arcs are made as texts reach
them; a second one runs from the clause's end, since a target or another insult may follow. A logistic layer weighs the
matched clauses: how many match each pattern, and how heavy they are.

The lexicon starts from a short fixed list and grows by words and word beginnings that tell toxic training documents
from others (a likelihood-ratio test); the pattern weights are fitted on the same documents. Both use a bounded sample
of labelled rows whose crc32 of the id is not 0 modulo 5. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import clean_docs

#: Labelled documents that lexicon and weights are fitted on: a bounded sample, chosen by a hash of doc_id.
SAMPLE_DOCS = 6000
#: Learned entries at most, the evidence that each needs, and the lengths of word beginnings tried.
LEARNED = 400
LEAST_RATIO = 40.0
BEGINNINGS = (3, 4, 5, 6, 7, 8)
FOLDS = 5

#: Cue words of the grammar.
SEEDS = {
    "insult": "idiot idiots moron morons stupid loser losers pathetic worthless disgusting scum trash clown imbecile bastard vermin crétin abruti connard salaud dummkopf arschloch abschaum estúpido imbécil escoria basura".split(),
    "threat": "kill hurt destroy punch beat hang shoot burn attack tuer frapper töten schlagen umbringen matar golpear".split(),
}
CUES = {
    "intent": "will i'll we'll gonna going shall should must want vais va vont werde wirst wird soll voy vas va quiero".split(),
    "target": "you your yours yourself u he she they him her them his their these those people tu vous toi il elle ils du dich dir ihr sie euch er tú usted ustedes él ella ellos".split(),
    "negation": "not no never none nobody isn't aren't wasn't don't didn't won't cannot can't without nor ne pas jamais sans nicht kein keine keinen nie niemals ohne sin nunca jamás ni".split(),
    "binder": "a an the this that these those such is are was were be being been am i'm you're he's she's they're it's so very really total totally complete utter absolute ein eine einen einem einer der die das den dem ist sind war bist so sehr total un une le la les des est es sont était si très el los las una unos unas son era eres tan muy".split(),
    "speech": "said says say told claimed claims called calls wrote writes quoted reported according dit disait déclaré selon sagte sagt laut behauptet dijo dice según afirmó".split(),
}
QUOTES = '"«»“”„'

#: What a word is read as, and what the insult and threat transducers make of it.
CLASSES = ("other", "insult", "learned", "harm", "intent", "target", "negation", "speech", "binder", "quote")
HITS = ("insult", "learned", "threat")
NEGATED, REPORTED, AIMED, BOUND = 1, 2, 4, 8
FLAGS = 16
#: Words after a binder, and between two insults, within which a word of insult is bound.
BINDS, PAIRS = 3, 40
#: Clauses with insults that are at most so many clauses apart make a tirade: their insults are bound as well.
TIRADE = 3


@dataclass(frozen=True)
class Transducer:
    """A deterministic transducer: (state, symbol) -> (state, symbol out, weight). State 0 starts every clause."""

    arcs: dict

    def run(self, symbols) -> Iterator[tuple]:
        state = 0
        for s in symbols:
            state, out, weight = self.arcs[state, s]
            yield out, weight


def machine(alphabet, states, step) -> Transducer:
    return Transducer({(q, s): step(q, s) for q in range(states) for s in alphabet})


class _Composed(dict):
    """Arcs of a composition, made when a text first takes them: of all pairs of states only few are ever met."""

    def __init__(self, a: dict, b: dict):
        super().__init__()
        self.a, self.b = a, b

    def __missing__(self, arc: tuple) -> tuple:
        qa, qb = arc[0] or (0, 0)
        qa, mid, wa = self.a[qa, arc[1]]
        qb, out, wb = self.b[qb, mid]
        self[arc] = made = ((qa, qb), out, wa * wb)
        return made


def compose(a: Transducer, b: Transducer) -> Transducer:
    """What ``a`` emits is read by ``b``; weights multiply."""
    return Transducer(_Composed(a.arcs, b.arcs))


def _scope(cues: tuple[str, ...], length: int, flag: int, weight: float, hits: tuple[str, ...]):
    """Marks what is in ``hits`` and stands within ``length`` words after a cue, once."""

    def step(state, symbol):
        kind, flags = symbol
        after = length if kind in cues else max(0, state - 1)
        if kind in hits and state and not flags & flag:
            return after, (kind, flags | flag), weight
        return after, symbol, 1.0

    return step


def _insult(state, symbol):
    """Words of insult are matches, bound ones where a binder or another insult stands before (or after, as the machine
    from the clause's end has marked)."""
    kind, flags = symbol
    bind, pair = divmod(state, PAIRS + 1)
    left = BINDS if kind == "binder" else max(0, bind - 1)
    if kind not in ("insult", "learned"):
        return left * (PAIRS + 1) + max(0, pair - 1), symbol, 1.0
    return left * (PAIRS + 1) + PAIRS, (f"{kind}!", flags | BOUND if bind or pair else flags), 1.25 if pair else 1.0


def _threat(state, symbol):
    """Verbs of harm are matches: bound and heavy ones within four words after a word of intent."""
    kind, flags = symbol
    after = 4 if kind == "intent" else max(0, state - 1)
    return (after, ("threat!", flags | BOUND if state else flags), 1.5 if state else 0.75) if kind == "harm" else (after, symbol, 1.0)


def _patterned(state, symbol):
    """A match that no pattern holds is a word like any other."""
    kind, flags = symbol
    return 0, (kind.rstrip("!"), flags) if kind.endswith("!") and not flags else symbol, 1.0


_MATCHES = tuple(f"{k}!" for k in HITS)


@lru_cache(maxsize=1)
def grammar() -> tuple[Transducer, Transducer]:
    """The machine that reads a clause from its end (targets and insults after a match), and the one that reads the result
    from its beginning: insults, threats, negation, reported speech, targets before a match, and what is no pattern."""
    words = [(kind, flags) for kind in CLASSES for flags in (0, AIMED, BOUND, AIMED | BOUND)]
    marked = [(kind, flags) for kind in (*CLASSES, *_MATCHES, "threat") for flags in range(FLAGS)]
    backward = compose(machine(words, 7, _scope(("target",), 6, AIMED, 1.25, ("insult", "learned", "harm"))), machine(words, PAIRS + 1, _scope(("insult", "learned"), PAIRS, BOUND, 1.0, ("insult", "learned"))))
    found = compose(machine(words, (BINDS + 1) * (PAIRS + 1), _insult), machine(marked, 5, _threat))
    negation = machine(marked, 5, _scope(("negation",), 4, NEGATED, 0.5, _MATCHES))
    speech = machine(marked, 41, _scope(("speech", "quote"), 40, REPORTED, 0.7, _MATCHES))
    target = machine(marked, 7, _scope(("target",), 6, AIMED, 1.25, _MATCHES))
    return backward, compose(compose(compose(compose(found, negation), speech), target), machine(marked, 1, _patterned))


def matches(classes: list[str], tirade: bool = False) -> list[tuple[str, int, float] | None]:
    """For each word of a clause the match (kind, flags, factor) that the grammar makes of it. ``tirade``: a clause near
    by holds insults too."""
    backward, forward = grammar()
    back = list(backward.run((c, BOUND if tirade and c in ("insult", "learned") else 0) for c in reversed(classes)))[::-1]
    out = []
    for ((kind, flags), factor), (_, before) in zip(forward.run(symbol for symbol, _ in back), back, strict=True):
        out.append((kind[:-1], flags, factor * before) if kind.endswith("!") else None)
    return out


#: (text, whole word, class, weight) of each entry of the lexicon.
Lexicon = tuple[tuple[str, bool, str, float], ...]

_WORD = re.compile(rf"\w[\w'’]*|[{QUOTES}]")
_CLAUSE_END = re.compile(r"[.!?;:\n]")
_TOKEN = re.compile(r"[^\W_]+")


def seed_lexicon() -> Lexicon:
    return tuple((w, True, "harm" if kind == "threat" else kind, 4.0) for kind, words in SEEDS.items() for w in words)


@lru_cache(maxsize=4)
def _matcher(lexicon: Lexicon):
    import ahocorasick

    best: dict[str, list] = {}
    for text, whole, kind, weight in lexicon:
        best.setdefault(text, []).append((len(text), whole, kind, weight))
    automaton = ahocorasick.Automaton()
    for text, entries in best.items():
        automaton.add_word(text, entries)
    if best:
        automaton.make_automaton()
    return automaton if best else None


@lru_cache(maxsize=1)
def _cues() -> dict[str, str]:
    return {w: kind for kind, words in CUES.items() for w in words} | dict.fromkeys(QUOTES, "quote")


def hits(text: str, lexicon: Lexicon) -> dict[int, tuple[str, float]]:
    """Words of a lower-case text that the lexicon holds: start -> class and weight, the heaviest entry of each."""
    automaton, found = _matcher(lexicon), {}
    if automaton is None:
        return found
    for end, entries in automaton.iter(text):
        for length, whole, kind, weight in entries:
            start = end + 1 - length
            if start and text[start - 1].isalnum():
                continue
            if whole and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            if start not in found or found[start][1] < weight:
                found[start] = (kind, weight)
    return found


#: Figures of a document: clauses by what they match, how heavy they are, and how long the text is.
N_FIGURES = len(HITS) * FLAGS + 9
#: Weights that the heaviest clause is held against.
HEAVY = (3.0, 8.0, 14.0, 24.0)


def figures(text: str, lexicon: Lexicon) -> np.ndarray:
    """Figures of the matched clauses of a whole text. A clause ends at a stop, colon or line end, however far."""
    low = text.lower()
    out, base = np.zeros(N_FIGURES), len(HITS) * FLAGS
    n_words = low.count(" ") + low.count("\n") + 1
    found = hits(low, lexicon)
    weights = []
    if found:
        ends = [m.start() for m in _CLAUSE_END.finditer(low)] + [len(low)]
        clauses = sorted({bisect_left(ends, start) for start in found})
        rude = sorted({bisect_left(ends, start) for start, (kind, _) in found.items() if kind != "harm"})
        tirade = {k for a, b in pairwise(rude) if b - a <= TIRADE for k in (a, b)}
        for k in clauses:
            words = list(_WORD.finditer(low, ends[k - 1] + 1 if k else 0, ends[k]))
            classes = [found[m.start()][0] if m.start() in found else _cues().get(m.group(), "other") for m in words]
            made = [(match, found[m.start()][1]) for m, match in zip(words, matches(classes, k in tirade), strict=True) if match]
            for kind, flags in {(match[0], match[1]) for match, _ in made}:
                out[HITS.index(kind) * FLAGS + flags] += 1
            if made:
                weights.append(sum(match[2] * weight for match, weight in made))
    total, heaviest = sum(weights), max(weights, default=0.0)
    out[:base] = np.log1p(out[:base])
    out[base:] = (np.log1p(total), np.log1p(len(weights)), np.log1p(heaviest), *(heaviest >= h for h in HEAVY), np.log1p(100.0 * total / n_words), np.log1p(n_words))
    return out


@dataclass
class Model:
    lexicon: Lexicon
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, text: str) -> float:
        x = (figures(text, self.lexicon) - self.mean) / self.scale
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30))))


def _sample(docs: DataFrame, labels: DataFrame, sample_docs: int) -> DataFrame:
    """(text, toxic) of at most ``sample_docs`` training documents, without copies."""
    i = F.col("doc_id").cast("long")
    train = F.pmod(F.crc32(i.cast("string").cast("binary")), F.lit(FOLDS)) != 0
    chosen = labels.filter(train).select(i.alias("_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1)").orderBy(F.xxhash64("_id"), "toxic").limit(sample_docs)
    return clean_docs(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select(F.coalesce("text", F.lit("")).alias("text"), "toxic").dropDuplicates(["text"])


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        counts: dict[tuple[str, bool], list[int]] = {}
        for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
            seen = set()
            for w in set(_TOKEN.findall(text.lower())):
                seen.add((w, True))
                seen.update((w[:k], False) for k in BEGINNINGS if k < len(w))
            for x in seen:
                counts.setdefault(x, [0, 0])[toxic] += 1
        yield pd.DataFrame([(t, whole, n[0], n[1]) for (t, whole), n in counts.items()], columns=["entry", "whole", "clean", "toxic"])


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Seeds and the entries with most evidence, each as short as its evidence allows."""
    totals = sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()
    n = {r["toxic"]: r["n"] for r in totals}
    clean, toxic = n.get(0, 0), n.get(1, 0)
    if not clean or not toxic:
        return seed_lexicon()
    counts = sample.mapInPandas(_evidence, "entry string, whole boolean, clean long, toxic long").groupBy("entry", "whole").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).filter("t >= 5")
    share = (F.col("c") + F.col("t")) / (clean + toxic)

    def term(k, expected):
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    ratio = 2 * (term(F.col("t"), share * toxic) + term(F.col("c"), share * clean))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1)) - F.log((F.col("c") + 0.5) / (clean + 1))
    rows = counts.withColumn("ratio", ratio).withColumn("odds", odds).filter((F.col("ratio") >= LEAST_RATIO) & (F.col("odds") > 2.0)).orderBy(F.desc("ratio"), "entry", "whole").limit(LEARNED).collect()
    kept: dict[tuple[str, bool], float] = {}
    for r in sorted(rows, key=lambda r: (len(r["entry"]), r["whole"])):
        shorter = [odds for (e, whole), odds in kept.items() if not whole and r["entry"].startswith(e)]
        if not shorter or r["odds"] > max(shorter) + 0.5:
            kept[r["entry"], r["whole"]] = r["odds"]
    return seed_lexicon() + tuple(sorted((e, whole, "learned", float(o)) for (e, whole), o in kept.items()))


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Logistic weights (the last is the intercept) by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Lexicon and weights. Only counts of entries and figures of the sample's documents reach the driver."""
    sample = _sample(docs, labels, sample_docs).persist()
    lexicon = learn_lexicon(sample)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"x": [figures(t, lexicon).tolist() for t in batch["text"]], "toxic": batch["toxic"]})

    rows = sample.mapInPandas(measure, "x array<double>, toxic int").collect()
    sample.unpersist()
    if len({r["toxic"] for r in rows}) < 2:  # nothing to learn from: a clause as heavy as two insults makes a text toxic
        weights = np.zeros(N_FIGURES + 1)
        weights[len(HITS) * FLAGS + 4], weights[-1] = 6.0, -3.0
        return Model(lexicon, np.zeros(N_FIGURES), np.ones(N_FIGURES), weights)
    x, y = np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], dtype=float)
    order = np.lexsort((*x.T, y))  # the same sum in any order of arrival
    x, y = x[order], y[order]
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    return Model(lexicon, mean, scale, _fit((x - mean) / scale, y))


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Null and empty texts are scored as texts without words. Rows without an id are not held out. Repeated rows repeat,
    an empty table gives none; other columns are not read. Without labels of both kinds, seeds and a fixed rule decide.
    """
    model = model or train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, type=pa.float64()), pa.array([int(s >= 0.5) for s in found], type=pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))
    return clean_docs(docs).select("doc_id", held.alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
