"""Exact dedup, SimHash groups and sharding against brute force on small tables."""

import hashlib
import random
import zlib

import pyarrow as pa
import pytest
import xxhash

from medgraph.llm import exact, sharding, simhash, suffix
from medgraph.llm.components import components

CLASH = "doc_id long, text string, fp long, hash long, bucket int, shard int, root string"


def _rows(seed=1, n=120):
    rng = random.Random(seed)
    base = [" ".join(rng.choice("alpha beta gamma delta of the and or é".split()) for _ in range(rng.randint(0, 60))) for _ in range(40)]
    rows = [(i, rng.choice(base)) for i in range(n)]
    rows += [(i, base[0] + f" {i % 3}") for i in range(200, 320)]  # many near copies
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, "one"), (1003, "one"), (None, "one"), (None, None), (1004, "long word " * 20_000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "r") for i, t in _rows()], CLASH)


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_exact_groups(docs):
    rows = [(i, t or "") for i, t in _rows()]
    want = []
    for i, t in rows:
        same = [j for j, u in rows if u == t]
        keep = max((j for j in same if j is not None), default=None)
        want.append((i, keep, len(same), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    for capacity in (exact.CAPACITY, 5):
        got = exact.exact_groups(docs, capacity).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        assert _sorted(got) == _sorted(want)


def test_directory_doubles_and_covers_every_place():
    rng = random.Random(3)
    counts = {rng.randrange(1 << 8) * 256 + rng.randrange(4): rng.randint(1, 4) for _ in range(500)}
    d = exact.Directory(counts, capacity=10)
    places = d.places()
    assert [p[0] for p in places] == list(range(1 << d.depth))
    assert sum(d.buckets.values()) == sum(counts.values())
    assert all(n <= 10 or depth == d.max_depth for (_, depth), n in d.buckets.items())
    assert exact.Directory({}).depth == exact.FIRST_DEPTH


def test_owners_chain_texts_that_share_a_hash_and_compare_their_bytes():
    rows = [(0, 3, 5, "b", 1, 1), (0, 3, 5, "a", 7, 2), (0, 3, 5, "b", None, 3), (0, 3, 5, "b", 4, 1), (0, 3, 6, "b", None, 2)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*part, strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=list("abcdef")) for part in (rows[:2], rows[2:])]
    got = [tuple(r.values()) for b in exact._own(iter(batches)) for r in b.to_pylist()]
    a, b = (hashlib.sha256(x).hexdigest() for x in (b"a", b"b"))
    assert got == [(0, 3, 5, 1, a, 2, 7), (0, 3, 5, 2, b, 5, 4), (0, 3, 6, 1, b, 2, None)]


def test_the_directory_decides_the_owner(docs):
    index = exact.build_index(docs, 5).collect()
    assert len({r.bucket for r in index}) > 8
    made = {(r.cell, r.bucket) for r in exact.directory(exact._hashed(docs), 5).collect()}
    assert all((r.hash % (1 << 64) >> (64 - exact.MAX_DEPTH), r.bucket) in made for r in index)


def test_stages_keep_columns_of_any_name(spark):
    names = "id_of_row, sha_of_row, sha_of_text, kept_id, kept_sha, gone_id, kept_text, was_cut, no_text, _id, _sha, _drop, Kept_ID_, n_chars".split(", ")
    passage = "a passage that is longer than fifty bytes and stands in two of the documents here"
    rows = [(1, f"first {passage} one"), (2, f"second {passage} two"), (2, f"second {passage} two"), (3, "short"), (4, "short"), (None, None), (5, None)]
    docs = spark.createDataFrame([(i, t, *range(len(names))) for i, t in rows], "doc_id long, text string, " + ", ".join(f"{n} long" for n in names))
    for stage, n in ((exact.drop_copies, 4), (simhash.drop_near_copies, 6), (suffix.remove_repeats, 7)):
        got = stage(docs)
        assert got.columns == docs.columns
        found = got.collect()
        assert len(found) == n and all(r._drop == 11 and r.gone_id == 5 for r in found)


def test_groups_of_equal_texts_are_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    shards = {}
    for r in sharding.shard_documents(docs).collect():
        shards.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert max(map(len, shards.values())) == 1


def test_map_versions_are_stored_read_back_and_edited(spark):
    name = f"test-{random.random()}"
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)], "doc_id long, text string")
    sharding.shard_documents(docs, shards=4, slots=64, name=name).count()
    first, second = ({r.virtual_slot: r.shard for r in sharding.load_map(spark, name, v).collect()} for v in (1, 2))
    assert list(first.values()) != list(second.values()) and len(second) == 64
    sizes = [r.bytes for r in sharding.load_map(spark, name, 2).orderBy("virtual_slot").collect()]
    third = {r.virtual_slot: r.shard for r in sharding.rebalance(spark, name, 2, sizes, 5).collect()}
    assert {third[k] for k in third if third[k] != second[k]} == {4}
    with pytest.raises(Exception, match="exists"):
        sharding.store_map(spark, name, 2, [0] * 64)


def test_drop_copies_keeps_one_row_of_each_text(docs):
    got = exact.drop_copies(docs)
    assert got.columns == docs.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in _rows()})


def _fingerprint(text, k):
    ws = (text or "").encode().lower().split()
    sh = [b" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)] or ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def _groups(rows, radius):
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if (rows[x][1] ^ rows[y][1]).bit_count() <= radius:
                up[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return [(i, f"{fp:016x}", least.get(root(x))) for x, (i, fp) in enumerate(rows)]


@pytest.mark.parametrize(("radius", "limit"), [(2, 256), (6, 3)])
def test_near_groups(docs, radius, limit):
    want = _groups([(i, _fingerprint(t, 3)) for i, t in _rows()], radius)
    assert _sorted(simhash.near_groups(docs, 3, radius, limit).collect()) == _sorted(want)


def test_links_of_random_fingerprints(spark):
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = {s ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 4))) & (2**64 - 1) for s in seeds for _ in range(12)}
    rows = [(i, fp) for i, fp in enumerate(sorted(fps))]
    want = {i: c for i, _, c in _groups(rows, 2)}
    df = spark.createDataFrame([(i, simhash._signed(fp)) for i, fp in rows], "doc_id long, fp long")
    roots = {r.node: r.root for r in components(simhash.links(df, 2, 4)).collect()}
    number = {simhash._signed(fp): i for i, fp in rows}
    got = {}
    for i, fp in rows:
        s = simhash._signed(fp)
        got.setdefault(roots.get(s, s), []).append(i)
    assert {frozenset(g) for g in got.values()} == {frozenset(i for i in want if want[i] == c) for c in set(want.values())}
    assert len(number) == len(rows)


def test_bk_tree_follows_only_near_edges():
    tree = simhash.Tree(simhash.build_tree([0, 1, 3, 7, 255, -1]).tobytes())
    assert sorted(tree.within(1, 1)) == [0, 1, 3]
    assert tree.within(-1, 2) == [-1]


def test_components_of_chains_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_sharding_law_and_slots(docs):
    rows = sharding.shard_documents(docs, shards=4, slots=64).collect()
    want = sorted(((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in _rows()))
    assert sorted((r["size"], r.text_crc32) for r in rows) == want
    for shard in range(4):
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_bytes_are_near_equal_with_a_heavy_group(spark):
    docs = spark.createDataFrame([(i, "copy of one text" if i % 3 == 0 else f"text number {i:05}") for i in range(6000)], "doc_id long, text string")
    load = {}
    for r in sharding.shard_documents(docs).collect():
        load[r.shard] = load.get(r.shard, 0) + r["size"]
    assert max(load.values()) - min(load.values()) < 0.01 * sum(load.values()) / 8


def test_growing_moves_slots_only_into_the_new_shard():
    rng = random.Random(2)
    sizes = [rng.randint(1, 1000) for _ in range(4096)]
    old = sharding.edit_map(sharding.first_map(4096, 8), sizes, 8)
    new = sharding.edit_map(old, sizes, 9)
    assert all(b == 8 for a, b in zip(old, new, strict=True) if a != b)
    load = [sum(s for s, x in zip(sizes, new, strict=True) if x == k) for k in range(9)]
    assert max(load) < 1.02 * sum(sizes) / 9


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact.exact_groups(docs).count() == simhash.near_groups(docs).count() == sharding.shard_documents(docs).count() == 0
