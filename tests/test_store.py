"""The snapshot store, continuous intake from files to edges, the reply store, the term trie and splittable records."""

import datetime
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from medgraph.operators import chunk, extract
from medgraph.sources import records
from medgraph.sources.snapshots import Conflict, Snapshots, Version
from medgraph.streaming import ingest


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_a_change_killed_between_two_tables_is_not_seen(spark, tmp_path):
    log = Snapshots(spark, f"file://{tmp_path}/store")
    good = spark.createDataFrame([(1,), (2,)], "x long")
    bad = good.withColumn("y", F.raise_error(F.lit("killed")))
    assert log.version() == Version(0, {}, {}) and _rows(log.read("a", "x long")) == []
    with pytest.raises(KeyError):
        log.read("a")
    assert log.commit({"a": good, "b": good}, "load", 0) == 1
    with pytest.raises(PySparkException):
        log.commit({"a": good, "b": bad}, "load", 1)
    assert log.versions() == [1] and _rows(log.read("a")) == [(1,), (2,)]
    for _ in range(2):  # the change is tried again, and then once more
        assert log.commit({"a": good, "b": good.limit(0)}, "load", 1) == 2
    assert _rows(log.read("a")) == [(1,), (1,), (2,), (2,)] and _rows(log.read("b")) == [(1,), (2,)]
    assert _rows(log.read("a", number=1)) == [(1,), (2,)]


def test_writers_that_meet(spark, tmp_path):
    one, two = (Snapshots(spark, f"file://{tmp_path}/store") for _ in range(2))
    rows = spark.createDataFrame([(1,)], "x long")
    one.commit({"a": rows})
    assert not two._publish(Version(1, {}, {}))  # the number is taken, and stays what it was
    two.commit({"a": rows})
    assert _rows(one.read("a")) == [(1,), (1,)]
    assert one.commit({"a": one.read("a").distinct()}, replace=True) == 3
    assert _rows(two.read("a")) == [(1,)]

    class Late:
        """A table during whose writing another change arrives."""

        schema = rows.schema

        @property
        def write(self):
            two.commit({"a": rows})
            return rows.write

    with pytest.raises(Conflict):
        one.commit({"a": Late()}, replace=True)


FILES = "doc_id long, filename string, content binary, doc_type string, ingested_at timestamp"


def test_files_arrive_and_become_edges(spark, tmp_path):
    at = [datetime.datetime(2024, 1, d) for d in (1, 2, 3, 4)]
    note = b"Fever. Amoxicillin treats pneumonia."
    first = spark.createDataFrame([(1, "a.txt", bytearray(note), "textbook", at[0]), (2, "b.html", bytearray(b"<p>No <b>fever</b></p>"), "textbook", at[1]), (3, "c.exe", bytearray(b"x"), "textbook", at[2]), (4, "bad.json", bytearray(b"{"), "textbook", at[3])], FILES)
    second = spark.createDataFrame([(5, "again.txt", bytearray(note), "textbook", at[0]), (6, "d.xml", bytearray("<r><p>pneumonia, amoxicillin é</p></r>".encode("latin-1").replace(b"<r>", b"<?xml version='1.0' encoding='latin-1'?><r>")), "textbook", at[1])], FILES)
    dictionary = spark.createDataFrame([("fever", "symptom"), ("pneumonia", "diagnosis"), ("amoxicillin", "treatment")], "normalized_term string, semantic_type string")
    rules = spark.createDataFrame([("amoxicillin", "pneumonia", "treats")], ingest.RULES)
    store = f"file://{tmp_path}/store"
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.stream_ingest(ingest.read_uploads(spark, str(tmp_path / "in"), FILES), store, str(tmp_path / "check"), dictionary, rules).awaitTermination()
    log = Snapshots(spark, store)
    assert [r.doc_id for r in log.read("documents").orderBy("doc_id").collect()] == [1, 2, 6]
    assert _rows(log.read("entities").select("doc_id", "name")) == [(1, "amoxicillin"), (1, "fever"), (1, "pneumonia"), (2, "fever"), (6, "amoxicillin"), (6, "pneumonia")]
    assert [r.relation_type for r in log.read("edges").collect()] == ["treats", "treats"]
    assert log.versions() == [1, 2]
    # the same batches from an earlier checkpoint change nothing: numbers 0 and 1 are there
    ingest.stream_ingest(ingest.read_uploads(spark, str(tmp_path / "in"), FILES), store, str(tmp_path / "other"), dictionary, rules).awaitTermination()
    assert log.versions() == [1, 2]


def _counting(folder, fails=()):
    """An extractor that leaves a file for each call."""

    def fn(text):
        import uuid

        (folder / f"{uuid.uuid4().hex}").write_text(text)
        if text in fails and not (folder.parent / "mended").exists():
            raise RuntimeError("the model is gone")
        return None if text.startswith("no reply") else text.upper()

    return fn, lambda: sorted(p.read_text() for p in folder.iterdir())


def test_replies_outlive_a_run(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    texts = ["a", "b", "c", "d", "e", "f", "g", "h"]
    chunks = spark.createDataFrame([(f"c{k}", k % 3, k, t) for k, t in enumerate([*texts, "a", "b", "no reply", "no reply"])], "chunk_id string, doc_id long, order int, text string")
    fn, calls = _counting(tmp_path / "calls", fails=("e",))
    store = f"file://{tmp_path}/store"
    ask = lambda: extract.extract_batch(chunks, fn, 2, across_documents=True, store=store, extractor="model", waves=4)
    with pytest.raises(PySparkException):
        ask()
    kept = {extract_key: reply for extract_key, reply in Snapshots(spark, store).read("model", extract.REPLIES).collect()}
    before = calls()
    (tmp_path / "mended").touch()
    got = ask()
    want = {f"c{k}": (t.upper(), k >= 8) for k, t in enumerate([*texts, "a", "b"])} | {"c10": (None, False), "c11": (None, False)}
    for _ in range(2):  # reading the result again calls nothing
        assert {r.chunk_id: (r.reply, r.reused) for r in got.collect()} == want
    again = [t for t in calls() if t not in ("no reply",)]
    # nothing that was kept before the crash was asked after it
    assert len(again) - len([t for t in before if t != "no reply"]) == 8 - len([r for r in kept.values() if r])
    n = len(calls())
    assert {r.chunk_id: r.reply for r in ask().collect()} == {c: r for c, (r, _) in want.items()}
    assert len(calls()) == n + 2  # only the failure is tried again, for itself and for its repeat


def test_results_are_read_without_calling_again(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    fn, calls = _counting(tmp_path / "calls")
    chunks = spark.createDataFrame([("c1", 1, 0, "a"), ("c2", 1, 1, "a"), ("c3", 2, 0, "a")], "chunk_id string, doc_id long, order int, text string")
    got = extract.extract_batch(chunks, fn, 2)
    assert [sorted((r.chunk_id, r.reused) for r in got.collect()) for _ in range(2)] == [[("c1", False), ("c2", True), ("c3", False)]] * 2
    assert calls() == ["a", "a"]


def test_terms_of_any_length(spark):
    words = "one two three four five six seven"
    dictionary = spark.createDataFrame([(words, "symptom"), ("two three", "diagnosis"), ("two", None), ("three four five six seven eight", "treatment"), ("lone", "odd")], "normalized_term string, semantic_type string")
    chunks = spark.createDataFrame([("c", 1, 0, f"Zero {words}. {words[:20]} lone"), ("d", 1, 1, ""), ("e", 1, 2, "two")], "chunk_id string, doc_id long, order int, text string")
    got = extract.dictionary_entities(chunks, dictionary).select("chunk_id", "pos", "n", "name", "entity_type")
    # "one two three four f": a path that ends before its term
    assert _rows(got) == sorted([("c", 1, 7, words, "symptom"), ("c", 2, 1, "two", "other"), ("c", 2, 2, "two three", "diagnosis"), ("c", 9, 1, "two", "other"), ("c", 9, 2, "two three", "diagnosis"), ("c", 13, 1, "lone", "other"), ("e", 0, 1, "two", "other")])
    assert extract.dictionary_entities(chunks, dictionary.limit(0)).collect() == []


def test_a_trie_knows_the_terms_below(spark):
    trie = extract.term_trie(spark.createDataFrame([("a b c", "x"), ("a b", "y"), ("d", "z")], "normalized_term string, semantic_type string"))
    assert _rows(trie) == [(1, "a", 3, False, None), (1, "d", 1, True, "z"), (2, "a b", 3, True, "y"), (3, "a b c", 3, True, "x")]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2k", "spark.sql.files.openCostInBytes": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def test_large_xml_is_read_by_several_tasks_like_the_whole(spark, tmp_path, small_splits):
    body = "".join(f"<rec id='{k}'><name>n{k} é</name><p>text <i>of</i> {k}</p><x:size>{k * 7}</x:size><recs><q>deep {k}</q></recs></rec>\n" for k in range(300))
    whole = f"<?xml version='1.0'?>\n<all xmlns:x='urn:x'><!-- no record -->{body}</all>\n"
    (tmp_path / "all.xml").write_text(whole)
    rows = records.xml_records(spark, f"file://{tmp_path}/all.xml", "rec")
    assert rows.rdd.getNumPartitions() > 5
    assert [r.paragraph for r in rows.orderBy("path", "start", "at", "pos").collect()] == list(records.xml_paragraphs(whole))
    assert len({r.start for r in rows.collect()}) > 5


def test_large_json_lines_are_read_by_several_tasks_like_the_whole(spark, tmp_path, small_splits):
    whole = "\n".join(json.dumps({"a": k, "b": ["x", "y"], "c": {"d": "é" * (k % 5)}}) + ("\n" if k % 7 == 0 else "") for k in range(400))
    (tmp_path / "all.jsonl").write_text(whole)
    rows = records.jsonl_records(spark, f"file://{tmp_path}/all.jsonl")
    assert rows.rdd.getNumPartitions() > 5
    assert [r.paragraph for r in rows.orderBy("path", "start", "at", "pos").collect()] == list(records.jsonl_paragraphs(whole))


def test_broken_records_are_error_rows(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><rec><a>1</a></rec><rec><a>1</b></rec><rec/><rec><a>2</a></rec></all>")
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n{\n')
    got = records.xml_records(spark, f"file://{tmp_path}/a.xml", "rec").orderBy("at").collect()
    assert [(r.paragraph, r.error is not None) for r in got] == [("a: 1", False), (None, True), ("a: 2", False)]
    got = records.jsonl_records(spark, f"file://{tmp_path}/a.jsonl").orderBy("at").collect()
    assert [(r.paragraph, r.error is not None) for r in got] == [("a: 1", False), (None, True)]


def test_chunks_of_a_store_are_those_of_a_batch(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(k, "textbook", f"h{k}", at, "Some text. " * (k * 40)) for k in range(1, 8)], "doc_id long, doc_type string, source_hash string, ingested_at timestamp, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.stream_ingest(ingest.read_uploads(spark, str(tmp_path / "in"), docs.schema), f"file://{tmp_path}/store", str(tmp_path / "check")).awaitTermination()
    assert _rows(Snapshots(spark, f"file://{tmp_path}/store").read("chunks").select("chunk_id", "text")) == _rows(chunk.chunk_documents(docs).select("chunk_id", "text"))


def test_the_ledger_of_a_stream_is_that_of_the_table(spark, tmp_path):
    from medgraph.operators import graph
    from medgraph.streaming import ledger

    hour = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    schema = "job long, ts timestamp, seq long, status string"
    batches = [
        [(1, hour(0), 1, "queued"), (1, hour(1), 2, "succeeded"), (2, hour(1), 3, "running"), (3, hour(2), 4, "queued"), (3, hour(2), 5, "failed")],
        [(4, hour(20), 6, "running"), (3, hour(20), 7, "running"), (1, hour(1.5), 8, "failed")],
        # hour 0 is long past; job 1 ended over a day before hour 40; job 2 still runs
        [(5, hour(40), 9, "succeeded"), (2, hour(0), 10, "failed"), (3, hour(21), 11, "succeeded")],
        [(6, hour(64), 12, "queued")],
    ]
    seen, late = [], {8, 10}  # older than the watermark when they came
    for at, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        events = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        ledger.stream_ledger(events, f"file://{tmp_path}/changes", str(tmp_path / "check")).awaitTermination()
        seen += [r for r in rows if r[2] not in late]
        got = _rows(ledger.ledger(spark.read.option("basePath", f"file://{tmp_path}/changes").parquet(f"file://{tmp_path}/changes")))
        assert got == _rows(graph.run_ledger(spark.createDataFrame(seen, schema))), at
    assert [r[0] for r in got] == [2, 4, 5, 6]
