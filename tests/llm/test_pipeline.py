"""The pipeline's stages on planted cases."""

import random

import corpus_pipeline
from medgraph.llm import packing
from medgraph.llm.shared import saved

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def _clean(rng, n=120):
    return ". ".join(" ".join(rng.choice("ab cd ef gh ij kl".split()) + rng.choice("mno pqr stu vwx yz".split()) + str(rng.randint(0, 999)) for _ in range(10)).capitalize() for _ in range(n // 10)) + "."


def test_stages(spark, tmp_path):
    rng = random.Random(8)
    rows = {i: _clean(rng) for i in range(60)}
    passage = _clean(rng, 60)
    rows[100], rows[101] = rows[3], rows[3]  # exact copies: the largest id stays
    near = rows[5].split()
    rows[102] = " ".join(near[:40] + ["changed"] + near[41:])
    rows[103], rows[104] = rows[7] + "\n" + passage, _clean(rng) + "\n" + passage
    rows[105], rows[106], rows[107] = "too short", None, "same words " * 100
    for i in range(200, 240):
        rows[i] = " | ".join(f"menu{rng.randint(0, 9999)}" for _ in range(60))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200), 0) for i in rows if i % 2], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = saved(stage(spark, now, str(tmp_path)), "stage")
        assert now.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in now.collect()}
    clean = set(range(60))
    assert clean | {100, 101, 102, 103, 104} == set(seen["quality_rules"])
    assert set(seen["exact_dedup"]) == set(seen["quality_rules"]) - {3, 100}
    assert set(seen["near_dedup"]) == set(seen["exact_dedup"]) - {102}
    assert set(seen["suffix_dedup"]) == set(seen["near_dedup"])
    assert passage in seen["suffix_dedup"][103] and rows[7] not in seen["suffix_dedup"][103]
    assert passage[:50] not in seen["suffix_dedup"][104]
    pieces = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in pieces.collect()} == set(seen["suffix_dedup"])
    assert packing.padding(pieces).first().tokens > 0


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
