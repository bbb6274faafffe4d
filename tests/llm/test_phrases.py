"""Phrase collocations: the index against counts by hand, the query against its SQL, planted cases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np

from medgraph.llm import phrases
from medgraph.llm.queries import ORACLES, QUERIES

CLASH = "doc_id long, lang string, text string, n long, id long, word string, shard long"


def _brute(rows, top, max_words, min_count):
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang, text = lang or "und", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, max_words + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, held in counts.items():
        frequent = {p: a for p, a in held.items() if a >= min_count}
        inside = {(p[i : i + w], a) for p, a in frequent.items() for w in range(2, len(p)) for i in range(len(p) - w + 1)}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and (p, a) not in inside:
                score, k = min((1000 * a * totals[lang] // (held[p[:k]] * held[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), held[p[:k]], held[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -score) for i, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def _rows(seed=5):
    rng = random.Random(seed)
    words = "Le la über x y \x01 B".split(" ") + ["tab"] * 2
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + rng.choice(".,\n\r!?") + "one two three four five six") for _ in range(150)]
    return [*rows, ("en", None), ("en", ""), (None, " \t "), ("en", "...;;;"), ("fr", "only"), ("en", "a  b\ta b " * 30_000)]


def test_against_counts_by_hand(spark):
    rows = _rows()
    df = spark.createDataFrame([(i, lang, text, 1, 2, "w", 3) for i, (lang, text) in enumerate(rows)], CLASH)
    for top, longest, least in ((2000, 5, 12), (3, 4, 5)):
        got = sorted(tuple(r) for r in phrases.collocations(df, top, longest, least).collect())
        assert got == _brute(rows, top, longest, least)


def test_shards_of_one_piece_each_give_the_same(spark, monkeypatch):
    rows = _rows(6)[:-1]
    df = spark.createDataFrame([(i, lang, text, 1, 2, "w", 3) for i, (lang, text) in enumerate(rows)], CLASH)
    text = " ".join(t or "" for _, t in rows).encode().translate(phrases._FOLD)
    monkeypatch.setattr(phrases, "SHARD_BYTES", 40)
    assert b"".join(phrases._runs(text)) == text and max(map(len, phrases._runs(text))) < 400
    assert sorted(tuple(r) for r in phrases.collocations(df, 50, 5, 9).collect()) == _brute(rows, 50, 5, 9)


def test_index_gives_every_phrase_with_its_count():
    rng = np.random.default_rng(2)
    x = phrases.shard_symbols(rng.integers(0, 5, 4_000), np.array([1, 2, 3]))
    assert x[0] == 0 and x[-1] == 0 and not ((x[1:] == 0) & (x[:-1] == 0)).any()
    index = phrases.Index(np.array([10, 20, 30]), phrases.transform(x), phrases.transform(x[::-1]))
    text, level, names = x.tolist(), index.words(), {10: (1,), 20: (2,), 30: (3,)}
    for length in range(2, 6):
        prefix, suffix, size = index.extensions(level)
        grams = [(*names[int(p)], names[int(s)][-1]) for p, s in zip(prefix, suffix, strict=True)]
        assert all(names[int(p)][1:] == names[int(s)][:-1] for p, s in zip(prefix, suffix, strict=True))
        want = Counter(tuple(text[i : i + length]) for i in range(len(text) - length + 1) if 0 not in text[i : i + length])
        assert dict(zip(grams, size.tolist(), strict=True)) == want
        ids = np.arange(len(grams)) + 1000 * length
        names, level = dict(zip(ids.tolist(), grams, strict=True)), index.next_level(level, prefix, suffix, ids)
        assert dict(zip(level[0].tolist(), level[5].tolist(), strict=True)) == dict(zip(ids.tolist(), size.tolist(), strict=True))


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], CLASH)).collect() == []


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = QUERIES["op12_phrases"](spark, folder)
    rows = sorted(tuple(r) for r in got.collect())
    assert rows and rows == sorted(db.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['op12_phrases']})").fetchall())
