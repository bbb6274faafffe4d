"""BPE encoding and decoding, and packing, against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pytest

from medgraph.llm import packing, tokens
from medgraph.llm.queries import vocabulary

TEXTS = [
    (1, "Hello, hello world!  it's\ttest123\n\nof words"),
    (2, None),
    (3, ""),
    (4, " \n "),
    (5, "abc<|endoftext|>DEF <|ENDOFTEXT|> Ünï ΑΣ ΣA\x85x\xa0y á b ́c"),
    (6, "Hello, hello world!  it's\ttest123\n\nof words"),
    (6, "same id again"),
    (None, "no id"),
    (7, "word " * 5000 + "tail"),
    (8, "日本語 emoji 😀 x</w>y \x00 \x1c z"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in TEXTS], "doc_id long, text string, block string, shard int, ids string")


@pytest.fixture(scope="module")
def reference():
    t = tokens.tokenizer(vocabulary())
    return [(i, t.encode(x or "", add_special_tokens=False).ids) for i, x in TEXTS]


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_digests(docs, reference):
    t = tokens.tokenizer(vocabulary())
    want = [(i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()) for i, ids in reference]
    assert _sorted(tokens.token_digests(docs, vocabulary()).collect()) == _sorted(want)


def test_encode_and_decode_tables(docs, reference):
    t = tokens.tokenizer(vocabulary())
    got = tokens.decode(tokens.encode(docs, vocabulary()), vocabulary()).collect()
    want = [(i, ids, t.decode(ids, skip_special_tokens=False)) for i, ids in reference]
    assert _sorted(got) == _sorted(want)


def test_packing_holds_every_id_once(docs, reference):
    rows = packing.pack_documents(docs.filter("coalesce(doc_id, 0) <> 6"), vocabulary(), window=256, block_bytes=300).collect()
    ids = {i: np.array([*x, packing.END_ID], dtype="<u4") for i, x in reference if i != 6}
    assert {r.doc_id for r in rows} == set(ids)
    for i, want in ids.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(want), zlib.crc32(want[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(want)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256


def test_repeated_rows_are_packed_each(spark):
    docs = spark.createDataFrame([(1, "a b c")] * 5, "doc_id long, text string")
    rows = packing.pack_documents(docs, vocabulary(), window=16).collect()
    assert [r.length for r in rows] == [4] * 5
    assert len({(r.sequence_id, r.offset) for r in rows}) == 5


def test_windows_best_fit_and_emit_fullest():
    w = packing.OpenWindows(size=100, n_open=2, slack=5)
    assert list(w.put(60)) == [(0, 0, 0, 60)]
    assert list(w.put(90)) == [(1, 0, 0, 90)]
    assert list(w.put(8)) == [(1, 90, 0, 8)]  # best fit
    assert list(w.put(50)) == [(2, 0, 0, 50)]  # none fits: window 1 lacks two tokens and goes as it is
    assert w.full == {1}
    assert list(w.put(70)) == [(0, 60, 0, 40), (2, 50, 40, 30)]  # the fullest is filled by cutting, the rest fits


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_digests(docs, vocabulary()).count() == 0
    assert packing.pack_documents(docs, vocabulary()).count() == 0


def test_marks_that_compose_in_lower_case_only(spark):
    texts = [(i, f"Some {letter}{mark} and {letter}{mark}ABC") for i, (letter, mark) in enumerate([("J", "\u030c"), ("H", "\u0331"), ("T", "\u0308"), ("W", "\u030a"), ("Y", "\u030a")])]
    t = tokens.tokenizer(vocabulary())
    got = tokens.encode(spark.createDataFrame(texts, "doc_id long, text string"), vocabulary()).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in got) == [(i, t.encode(x, add_special_tokens=False).ids) for i, x in texts]
