"""Near copies of the pipeline: five-word Jaccard similarity decides, not the fingerprints."""

import random

from medgraph.llm import simhash


def test_similarity_decides(spark):
    rng = random.Random(4)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))

    few = [word() for _ in range(200)]
    rows = {i: [rng.choice(few) for _ in range(8000)] for i in range(4)}  # one set of words, no text like another
    copies = set()
    for i in range(10, 40):
        rows[i] = [word() for _ in range(60 + 5 * i)]
        rows[i + 100] = list(rows[i])
        for n in range(max(1, len(rows[i]) // 100)):  # Jaccard of 0.85 or more, words all over the text
            rows[i + 100][50 + 100 * n] = word()
        copies.add(i + 100)
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in rows.items()], "doc_id long, text string")
    left = {r.doc_id for r in simhash.drop_near_copies(docs).collect()}
    assert left == set(rows) - copies


def test_rows_that_stay(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " "), (None, "same text"), (4, "same text"), (5, "Same  text"), (None, "same text")], "doc_id long, text string")
    left = simhash.drop_near_copies(docs).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 0, 1, 2, 3, 4]
