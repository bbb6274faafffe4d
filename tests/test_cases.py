"""Small cases with exact expected rows, one group per module."""

import datetime
import random
import re

import pytest
from pyspark.sql import functions as F

from medgraph.functions import text as T
from medgraph.operators import chunk, corpus, deid, extract, graph, retrieve
from medgraph.sources import files, records
from medgraph.sources.snapshots import Snapshots
from medgraph.streaming import ingest


def _one(spark, value, fn, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(fn(F.col("x")).alias("y")).first().y


# --- text


@pytest.mark.parametrize(
    ("raw", "want"),
    [(b"\xef\xbb\xbfabc", "abc"), ("é".encode("utf-16"), "é"), (b"a\xffb", "a�b"), (b"", "")],
)
def test_decode(spark, raw, want):
    assert _one(spark, bytearray(raw), T.decode, "binary") == want


def test_tidy_and_normalize(spark):
    assert _one(spark, " a   b \n\n\n\n c\t\n", T.tidy) == "a b\n\nc"
    assert _one(spark, "  Heart\n  Attack ", T.normalize_term) == "heart attack"


def test_html(spark):
    page = "<html><head><title>T &amp; U</title><style>x</style></head><body><!-- c --><nav>menu</nav><p>One<b>two</b><p>Three<br>four<table><tr><td>a</td><td>b</td></tr></table><script>if (1) '</p>'</script></body></html>"
    assert _one(spark, page, T.html_to_text) == "T & U\n\nOnetwo\n\nThree\nfour\n\na | b"


def test_markdown(spark):
    raw = "---\na: 1\n---\n# Title #\n\n- [x] **Bold** and *it*\n> quote [text](http://x) ![alt](y)\n\n| a | b |\n|---|---|\n| 1 | 2 |\n```py\ncode\n```\n~~old~~ `c` snake_case_name"
    assert _one(spark, raw, T.markdown_to_text) == "Title\n\nBold and it\nquote text alt\n\na | b\n1 | 2\n\ncode\n\nold c snake_case_name"


def test_terms(spark):
    terms = _one(spark, "What are the side effects of beta-blockers for P-0042?", T.question_terms)
    assert {"side effects", "beta-blockers", "effects of beta-blockers", "side"} <= set(terms)
    assert not any("p-0042" in t or t.startswith("the") for t in terms)
    assert _one(spark, "p-0042 and P-12345, P-12", T.find_pseudonyms) == ["P-0042", "P-12345"]
    assert _one(spark, ["ไข้", "สูง"], T.thai_terms, "array<string>") == ["ไข้", "สูง", "ไข้ สูง", "ไข้สูง"]


def test_ocr_rules(spark):
    rows = [("text", None, True), ("text", 0.0, True), (" \n", 100.0, True), ("x" * 10, 10000.0, True), ("x" * 100, 10000.0, False), ("x" * 50, 10000.0, False)]
    got = spark.createDataFrame(rows, "t string, a double, want boolean").select(T.needs_ocr("t", "a").alias("y"), "want").collect()
    assert all(r.y == r.want for r in got)


# --- readers


def test_xml():
    raw = "<r xmlns='u'><name>Ann</name><p>Some <i>mixed</i> text</p><age>5</age><sub><x>1</x></sub><!-- c --></r>"
    assert list(records.xml_paragraphs(raw)) == ["name: Ann\nage: 5", "Some mixed text", "x: 1"]
    assert list(records.xml_paragraphs("<a>" + "w " * 150 + "</a>")) == [("w " * 150).strip()]


def test_json():
    raw = '{"a": 1, "ok": true, "none": null, "tags": ["x", "y"], "sub": {"b": 2}, "long": "' + "w" * 200 + '", "items": [{"c": 3}, {"c": 4}]}'
    assert list(records.json_paragraphs(raw)) == ["a: 1\nok: yes\ntags: x, y", "sub\nb: 2", "long:\n" + "w" * 200, "items\nc: 3", "items\nc: 4"]
    assert list(records.jsonl_paragraphs('{"a": 1}\n\n"text"')) == ["a: 1", "text"]
    with pytest.raises(ValueError, match="line 2"):
        list(records.jsonl_paragraphs('{"a": 1}\n{'))


def test_delimited():
    assert list(records.delimited_paragraphs("name;;age\nAnn;x;5\n;;\nBob;;;9", ";")) == ["name: Ann\ncolumn 2: x\nage: 5", "name: Bob\ncolumn 4: 9"]
    assert list(records.delimited_paragraphs("a\tb\n1\t2", "\t")) == ["a: 1\nb: 2"]


def test_bad_files_are_error_rows(spark):
    rows = records.paragraph_rows(spark.createDataFrame([(1, "<a>"), (2, "<a>b</a>"), (3, None)], "doc_id long, raw string"), "raw", records.xml_paragraphs).collect()
    assert [(r.doc_id, r.paragraph, r.error is not None) for r in rows] == [(1, None, True), (2, "a: b", False)]


def test_intake(spark, tmp_path):
    for name, raw in {"a.TXT": b"plain", "b.html": b"<p>x</p>", "c.json": b'{"k": 1}', "d.exe": b"?", "e.xml": b"<a"}.items():
        (tmp_path / name).write_bytes(raw)
    accepted, rejected = files.intake(files.read_files(spark, str(tmp_path)))
    assert {r.filename: r.reader for r in accepted.collect()} == {"a.TXT": "text", "b.html": "html", "c.json": "json", "e.xml": "xml"}
    assert [r.filename for r in rejected.collect()] == ["d.exe"]
    numbered = accepted.withColumn("doc_id", F.ascii("filename").cast("long"))
    texts = {chr(r.doc_id): (r.text, r.error is None) for r in files.read_texts(numbered).collect()}
    assert texts["a"] == ("plain", True) and texts["b"] == ("x", True) and texts["c"] == ("k: 1", True) and not texts["e"][1]


# --- chunks


def test_textbook_chunks():
    assert chunk.textbook("a\n\nb\n \nc", 100) == ["a\n\nb\n\nc"]
    assert chunk.textbook("aaaa\n\nbbbb\n\ncccc", 8) == ["aaaa\n\nbbbb", "cccc"]
    long = "One two three. Four five six! Seven eight nine?"
    assert chunk.textbook(f"x\n\n{long}\n\ny", 30) == ["x", "One two three. Four five six!", "Seven eight nine?", "y"]
    assert chunk.textbook("\n".join(f"field {i}: value" for i in range(200)), 300) and all(len(b) <= 300 for b in chunk.textbook("\n".join(f"field {i}: value" for i in range(200)), 300))
    assert chunk.textbook("") == []


def test_patient_chunks():
    note = "Name: Ann\nSubjective:\nfever\n\nObjective:\n38.5\nASSESSMENT\npneumonia\nPlan:\nrest"
    assert chunk.patient(note) == ["Subjective:\nfever", "Objective:\n38.5", "ASSESSMENT\npneumonia", "Plan:\nrest"]
    assert chunk.patient("Intro\n\nPlan:\nrest") == ["Intro\n\nPlan:\nrest"]
    assert chunk.patient("no header") == ["no header"] and chunk.patient("") == []


# --- de-identification


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mr. John Smith has fever. Smith is stable.", "Mr. [PERSON-1] has fever. [PERSON-1] is stable."),
        ("HN: 12-345678 on 03/04/2024, call 555-123-4567 or a.b@c.org", "HN: [ID] on [DATE], call [PHONE] or [EMAIL]"),
        ("HN none. Born 5 March 2001", "HN none. Born [DATE]"),
        ("Name: Jane Doe\nAssessment:\nDr. Jones saw Jane", "Name: [PERSON-1]\nAssessment:\nDr. [PERSON-2] saw [PERSON-1]"),
        ("นายสมชาย ใจดี มีไข้ สมชายดีขึ้น นายแพทย์", "นาย[PERSON-1] มีไข้ [PERSON-1]ดีขึ้น นายแพทย์"),
    ],
)
def test_deidentify(text, want):
    (got,) = deid.clean_texts([text], deid.rules())
    if "สมชาย" in text:
        assert "สมชาย" not in got and "นายแพทย์" in got
    else:
        assert got == want


def test_deidentify_outside_spans_and_own_ids(spark):
    docs = spark.createDataFrame([("Anna met X-99.", [(0, 4, "PERSON")])], "text string, ner array<struct<start:int,end:int,kind:string>>")
    assert docs.select(deid.deidentify(F.col("text"), F.col("ner"), [r"X-\d+"]).alias("y")).first().y == "[PERSON-1] met [ID]."


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Mrs. Anne-Marie Low\nMs. Marie-Claire Fox\nSeen with Anne-Marie-Claire.", "Mrs. [PERSON-1]\nMs. [PERSON-2]\nSeen with [PERSON-3]."),
        ("นายสมชาย\nนางชายดี\nพบสมชายดี", "นาย[PERSON-1]\nนาง[PERSON-2]\nพบ[PERSON-3]"),
    ],
)
def test_names_that_overlap_are_all_removed(text, want):
    assert deid.clean_texts([text], deid.rules()) == [want]


def test_no_word_of_a_known_name_is_left():
    """Names made of parts of one another, in any order and glued together."""
    rng = random.Random(3)
    parts = ["Anna", "Marie", "Clara", "Joan"]
    thai = ["สมชาย", "ชายดี", "ดีมาก", "มากศรี"]
    for _ in range(200):
        names = ["-".join(rng.sample(parts, 2)) for _ in range(3)]
        words = rng.sample(thai, 2)
        text = "".join(f"Mr. {n}.\n" for n in names) + "".join(f"นาย{w}\n" for w in words) + "Seen with " + "-".join(rng.choices(parts, k=4)) + " and " + "สมชายดีมากศรี"
        (clean,) = deid.clean_texts([text], deid.rules())
        assert not any(re.search(rf"\b{re.escape(n)}\b", clean) for n in names) and not any(w in clean for w in words)


def test_merge():
    assert deid.islands([(0, 5, "A"), (3, 10, "B"), (10, 12, "C"), (4, 6, "D")]) == [(0, 10, "B"), (10, 12, "C")]


def test_pseudonyms(spark):
    docs = spark.createDataFrame([(i, datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=-i)) for i in range(5)], "doc_id long, ingested_at timestamp")
    old = spark.createDataFrame([(3, "P-10000")], "doc_id long, pseudonym string")
    assert {r.doc_id: r.pseudonym for r in deid.assign_pseudonyms(docs, old).collect()} == {3: "P-10000", 4: "P-10001", 2: "P-10002", 1: "P-10003", 0: "P-10004"}


def test_backfill(spark):
    chunks = spark.createDataFrame([("c1", 1, 0, "Mr. John Smith has fever.", "patient_record", None), ("c2", 2, 0, "Mr. Al Bee", "textbook", None)], "chunk_id string, doc_id long, order int, text string, source_type string, deidentified boolean")
    entities = spark.createDataFrame([("e1", 1, "John Smith"), ("e2", 1, "fever"), ("e3", 2, "Al Bee")], "entity_id string, doc_id long, name string")
    after, left, counts = deid.backfill(chunks, entities)
    assert {r.chunk_id: (r.text, r.deidentified) for r in after.collect()} == {"c1": ("Mr. [PERSON-1] has fever.", True), "c2": ("Mr. Al Bee", None)}
    assert {r.entity_id for r in left.collect()} == {"e2", "e3"}
    assert [tuple(r) for r in counts.collect()] == [(1, 1, 1)]


# --- extraction


def test_replies(spark):
    replies = [
        (1, "a", '{"entities": [{"name": " Fever "}, 5, {"name": ""}, {"name": "fever", "entity_type": "symptom"}, {"name": "Drug", "entity_type": "x"}], "relations": [{"source": "drug", "target": "FEVER", "relation_type": "treats"}, {"source": "drug", "target": "drug"}, {"source": "drug", "target": "none"}]}'),
        (1, "b", '```json\n{"entities": []}\n```'),
        (1, "c", "[1, 2]"),
        (1, "d", "sorry"),
        (1, "e", None),
        (1, "f", '{"entities": null}'),
    ]
    df = spark.createDataFrame(replies, "doc_id long, chunk_id string, reply string")
    assert {r.chunk_id for r in extract.failed_chunks(df).collect()} == {"c", "d", "e"}
    entities = extract.parse_entities(df)
    assert sorted((r.pos, r.name, r.normalized_name, r.entity_type) for r in entities.collect()) == [(0, "Fever", "fever", "other"), (3, "fever", "fever", "symptom"), (4, "Drug", "drug", "other")]
    ids = {r.pos: r.entity_id for r in entities.collect()}
    assert [(r.source_id, r.target_id, r.relation_type) for r in extract.parse_relations(df, entities).collect()] == [(ids[4], ids[3], "treats")]


def test_reuse_and_failures(spark):
    chunks = spark.createDataFrame([("c0", 1, 0, "same"), ("c1", 1, 1, "bad"), ("c2", 1, 2, "same"), ("c3", 2, 0, "same")], "chunk_id string, doc_id long, order int, text string")
    got = {r.chunk_id: (r.reply, r.reused) for r in extract.extract_batch(chunks, lambda t: None if t == "bad" else t.upper(), 2).collect()}
    assert got == {"c0": ("SAME", False), "c1": (None, False), "c2": ("SAME", True), "c3": ("SAME", False)}


# --- graph


def test_duplicates(spark):
    t = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, "h", "a", t(1), False), (2, "h", "a", t(2), None), (3, "h", "a", t(3), True), (4, "i", "a", t(1), False), (5, "i", "a", t(2), False), (6, "i", "b", t(3), False)]
    docs = spark.createDataFrame(rows, "doc_id long, source_hash string, doc_type string, ingested_at timestamp, ingestion_complete boolean")
    assert {r.doc_id: r.action for r in graph.duplicate_actions(docs).collect()} == {1: "delete", 2: "keep", 3: "leave", 4: "delete", 5: "resume", 6: "resume"}


def test_places_in_hot_groups(spark):
    """Half of all rows under one key, a null key, and more partitions than groups."""
    dice = random.Random(3)
    rows = [("hot" if dice.random() < 0.5 else dice.choice(["a", "b", None]), i) for i in range(400)]
    rows_of = {k: sorted(i for key, i in rows if key == k) for k in ("hot", "a", "b", None)}
    df = spark.createDataFrame(rows, "k string, i int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = graph.place_in_group(df, ["k"], ["i"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.k, r.i): r.place for r in got} == {(k, i): n for k, mine in rows_of.items() for n, i in enumerate(mine, 1)}
    assert graph.place_in_group(df.filter("false"), ["k"], ["i"]).collect() == []


def test_the_nested_dump_has_relations(spark):
    flat = spark.createDataFrame([(1, "f", "textbook", "c1", 0, "t", "e1", "fever", "symptom", "hot"), (1, "f", "textbook", "c2", 1, "u", None, None, None, None), (2, "g", "textbook", "c3", 0, "v", None, None, None, None)], "doc_id long, filename string, doc_type string, chunk_id string, order int, text string, entity_id string, name string, entity_type string, definition_text string")
    entities = spark.createDataFrame([("e1", "fever"), ("e2", "rest")], "entity_id string, name string")
    edges = spark.createDataFrame([(1, "e2", "e1", "treats")] * 2, "doc_id long, source_id string, target_id string, relation_type string")
    got = {r.doc_id: r for r in graph.nested_graph(flat, graph.document_relations(entities, edges)).collect()}
    assert [tuple(r) for r in got[1].relations] == [("rest", "treats", "fever")] and got[2].relations == []
    assert [(c.chunk_id, len(c.entities)) for c in got[1].chunks] == [("c1", 1), ("c2", 0)]


def test_resume(spark):
    old = spark.createDataFrame([(1, 0, "a", True), (1, 1, "b", False), (1, 2, "old", True), (1, 9, "z", True), (2, 0, "a", None), (2, 1, "b", None)], "doc_id long, order int, text string, extracted boolean")
    new = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 3, "d"), (2, 0, "a"), (2, 1, "b")], "doc_id long, order int, text string")
    got = sorted((r.doc_id, r.order, r.action) for r in graph.resume_plan(old, new).collect())
    assert got == sorted([(1, 0, "reuse"), (1, 1, "delete"), (1, 1, "todo"), (1, 2, "delete"), (1, 2, "todo"), (1, 3, "todo"), (1, 9, "delete"), (2, 0, "reuse"), (2, 1, "delete"), (2, 1, "todo")])


def test_written_tables_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, doc_type string")
    for _ in range(2):
        graph.write_table(df, str(tmp_path / "t"), "doc_type")
    graph.write_table(df.filter("id = 1").withColumn("id", F.lit(7).cast("long")), str(tmp_path / "t"), "doc_type")
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [2, 7]


# --- retrieval


def test_follow_ups(spark):
    turns = [(1, 0, "user", "Tell me about pneumonia in P-0042"), (1, 1, "assistant", "..."), (1, 2, "user", "and its treatment?"), (1, 3, "user", "why?"), (1, 4, "user", "who?")]
    got = {r.turn: r for r in retrieve.user_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert got[2].pseudonyms == ["P-0042"] and "pneumonia" in got[2].earlier_terms
    assert got[3].pseudonyms == ["P-0042"] and got[4].pseudonyms == [] and "pneumonia" not in got[4].earlier_terms


def test_unreadable_chunks_never_show(spark):
    chunks = spark.createDataFrame([("c1", 1, 0, "t", "patient_record", None), ("c2", 2, 0, "t", "patient_record", True), ("c3", 3, 0, "t", "textbook", None)], "chunk_id string, doc_id long, order int, text string, source_type string, deidentified boolean")
    entities = spark.createDataFrame([(f"e{i}", f"c{i}", i, "fever") for i in (1, 2, 3)], "entity_id string, chunk_id string, doc_id long, normalized_name string")
    none = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    terms = spark.createDataFrame([(1, "fever")], "question_id long, term string")
    defined = spark.createDataFrame([], "normalized_name string, normalized_term string")
    assert {r.chunk_id for r in retrieve.search(terms, chunks, entities, none, defined).collect()} == {"c2", "c3"}


def test_chat_messages(spark):
    said = [(1, n, "user" if n % 2 == 0 else "assistant", f"m{n}") for n in range(9)] + [(1, 9, "tool", "x"), (1, 10, "user", "now?"), (2, 0, "user", None)]
    conversations = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    sources = spark.createDataFrame([("1/10", 2, "b.txt", "two", None), ("1/10", 1, "a.txt", "x" * 2001, 7), ("2/0", 1, "a.txt", "one", None)], "question_id string, number int, source_label string, text string, page_number int")
    got = {r.question_id: [tuple(m) for m in r.messages] for r in retrieve.chat_messages(conversations, sources, "rules").collect()}
    prompt = "Sources:\n\n[1] a.txt, page 7\n" + "x" * 2000 + " …\n\n[2] b.txt\ntwo\n\nQuestion: now?"
    assert got["1/10"] == [("system", "rules"), *[("user" if n % 2 == 0 else "assistant", f"m{n}") for n in range(4, 9)], ("user", prompt)]
    assert got["2/0"] == [("system", "rules"), ("user", "Sources:\n\n[1] a.txt\none\n\nQuestion: ")] and len(got) == 2


def test_mentions_are_found_under_the_name_of_their_definition(spark):
    entities = spark.createDataFrame([("e1", 1, "c1", "mi"), ("e2", 1, "c1", "mi"), ("e3", 2, "c2", "heart attack"), ("e4", 3, "c3", "fever")], "entity_id string, doc_id long, chunk_id string, normalized_name string")
    links = spark.createDataFrame([("mi", "heart attack", "s"), ("mi", "heart attack", "s"), ("heart attack", "heart attack", "s"), ("fever", None, "s")], "normalized_name string, normalized_term string, source string")
    edges = extract.defined_as(entities, links)
    assert sorted((r.entity_id, r.normalized_term) for r in edges.collect()) == [("e1", "heart attack"), ("e2", "heart attack"), ("e3", "heart attack")]
    chunks = spark.createDataFrame([(f"c{i}", i, 0, "t", "textbook", None) for i in (1, 2, 3)], "chunk_id string, doc_id long, order int, text string, source_type string, deidentified boolean")
    none = spark.createDataFrame([], "source_id string, target_id string, relation_type string")
    terms = spark.createDataFrame([(1, "heart attack"), (2, "mi")], "question_id long, term string")
    got = {(r.question_id, r.chunk_id) for r in retrieve.search(terms, chunks, entities, none, edges).collect()}
    assert got == {(1, "c1"), (1, "c2"), (2, "c1")}


@pytest.mark.parametrize("seed_postings", [1, 30, 10**6])
def test_upper_bounds_change_nothing(spark, seed_postings):
    """Names in a third of all chunks, rare ones, ties, questions without any mention, and questions with a scope."""
    dice = random.Random(5)
    names = {f"hot{i}": 3 for i in range(3)} | {f"warm{i}": 12 for i in range(4)} | {f"rare{i}": 60 for i in range(20)}
    held = [(f"c{c}", c // 5, c % 5, n) for c in range(600) for n, share in names.items() if dice.randrange(share) == 0]
    held += [(f"c{c}", c // 5, c % 5, n) for c in range(8) for n in ("both", "pair")]
    mentioned = spark.createDataFrame(held, "chunk_id string, doc_id long, order int, name string").persist()
    asked = [(q, n, dice.choice([1.0, 0.5])) for q in range(25) for n in dice.sample(sorted(names), 6)] + [(97, n, 1.0) for n in ("both", "pair", "hot0")] + [(98, "nowhere", 1.0), (99, "hot0", 1.0), (99, "hot1", 1.0)]
    weighted = spark.createDataFrame(asked, "question_id int, name string, weight double").persist()
    scope = spark.createDataFrame([(q, d) for q in (3, 4) for d in range(40)] + [(5, None)], "question_id int, doc_id long")
    for limited in (None, scope):
        kept = []
        got = retrieve.search_postings(weighted, mentioned, limited, 6, seed_postings, cut=lambda df: kept.append(df.persist()) or kept[-1])
        assert sorted(got.collect()) == sorted(retrieve.top_k(retrieve.score(weighted, mentioned, limited), 6).collect())
        if seed_postings == 30 and limited is None:
            _, _, ranked, able = kept
            read = ranked.filter("seed OR NOT optional").join(mentioned, "name").count()
            looked_up = able.join(ranked.filter("optional AND NOT seed").select("question_id", "name"), "question_id").join(mentioned.select("name", "chunk_id"), ["name", "chunk_id"]).count()
            assert read + looked_up < weighted.join(mentioned, "name").count()
            # rare names that stand together: the frequent one's 200 chunks are not read, but for those of the pair
            assert [r.name for r in ranked.filter("question_id = 97 AND optional AND NOT seed").collect()] == ["hot0"]
            assert able.filter("question_id = 97").count() == 8


# --- corpus, manifest, streams


def test_report_and_manifest_round_trip(spark, tmp_path):
    row = ("FAIL-SIZE", 5, "-", "-", "http://x", "corpus", "green", "n\tame", "t", "-", "-", "a\nb")
    manifest = spark.createDataFrame([row], ", ".join(f"{c} {'long' if c == 'bytes' else 'string'}" for c in corpus.MANIFEST)).withColumn("name", F.lit("name")).withColumn("notes", F.lit("note"))
    files.write_manifest(manifest, str(tmp_path / "m"))
    assert files.read_manifest(spark, str(tmp_path / "m")).collect() == manifest.collect()
    assert [(r["rank"], r["status"]) for r in corpus.skip_report(manifest).collect()] == [(5, "FAIL-SIZE")]
    lines = [tuple(r) for r in corpus.report_lines(manifest).orderBy("rank", "name").collect()]
    assert lines == [(5, "", "## Failed content verification this run (undersized)"), (5, "name", "- **name** (`corpus`/`green`) — http://x\n  note"), (8, "", "0 source(s) successfully fetched and verified.")]
    fine = manifest.withColumn("status", F.lit("OK"))
    assert [r.line for r in corpus.report_lines(fine).orderBy("rank").collect()] == [corpus.NOTHING, "1 source(s) successfully fetched and verified."]
    assert [r.line[:1] for r in corpus.report_lines(fine.filter("false")).orderBy("rank").collect()] == ["N", "0"]


def test_dictionary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"terms": [{"term": "Fever ", "definition_text": "hot"}, {"definition_text": "no term"}]}')
    (tmp_path / "b.json").write_text('{"terms": [\n{"term": "fever", "definition_text": "warm", "source": "s", "source_id": "7"}]}')
    (tmp_path / "c.json").write_text("{}")
    entries = files.read_dictionary(spark, str(tmp_path))
    assert sorted((r.term, r.source) for r in entries.collect()) == [("Fever ", "stub"), ("fever", "s")]
    assert [(r.normalized_term, r.definition_text, r.source_id) for r in extract.load_definitions(entries).collect()] == [("fever", "warm", "7")]


def test_stream_equals_batch_and_survives_a_restart(spark, tmp_path):
    schema = "doc_id long, doc_type string, source_hash string, ingested_at timestamp, text string"
    at = datetime.datetime(2024, 1, 1)
    first = spark.createDataFrame([(1, "textbook", "h1", at, "one"), (2, "textbook", "h1", at, "one"), (3, "patient_record", "h1", at, "one")], schema)
    second = spark.createDataFrame([(4, "textbook", "h1", at, "one"), (5, "textbook", "h2", at, "two")], schema)
    for batch in (first, second):
        batch.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        uploads = ingest.read_uploads(spark, str(tmp_path / "in"), schema)
        ingest.stream_ingest(uploads, f"file://{tmp_path}/store", str(tmp_path / "check")).awaitTermination()
    assert sorted(r.doc_id for r in Snapshots(spark, f"file://{tmp_path}/store").read("chunks").collect()) == [1, 3, 5]


def test_patients_named_alone(spark):
    chunks = spark.createDataFrame([(f"c{d}{o}", d, o, "text", "textbook", True) for d in (1, 2) for o in range(5)], "chunk_id string, doc_id long, order int, text string, source_type string, deidentified boolean")
    scope = spark.createDataFrame([("q", 1), ("q", 2)], "question_id string, doc_id long")
    got = retrieve.pseudonym_listing(scope, chunks, 6).orderBy("number").collect()
    assert [(r.doc_id, r.order) for r in got] == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]


def test_a_failed_repeat_is_tried_alone(spark):
    chunks = spark.createDataFrame([("a", 1, 0, "bad"), ("b", 1, 1, "bad"), ("c", 1, 2, "good"), ("d", 1, 3, "good")], "chunk_id string, doc_id long, order int, text string")
    got = {r.chunk_id: (r.reply, r.reused) for r in extract.extract_batch(chunks, lambda t: None if t == "bad" else t, 1).collect()}
    assert got == {"a": (None, False), "b": (None, False), "c": ("good", False), "d": ("good", True)}


def test_decoding_and_character_references(spark):
    from medgraph.functions import text as T

    raw = [b"\xff\xfea\x00\xe9", b"\xff\xfea\x00\x00\xd8", "﻿bé".encode(), None]
    rows = spark.createDataFrame([(k, bytearray(r) if r is not None else None) for k, r in enumerate(raw)], "k int, raw binary")
    assert [r.t for r in rows.orderBy("k").select(T.decode("raw").alias("t")).collect()] == ["a�", "a�", "bé", None]
    page = spark.createDataFrame([("<p>caf&eacute; &#8217;x&#x2014; &amp;lt; plain</p>",)], "html string")
    assert page.select(T.html_to_text("html").alias("t")).first().t == "café ’x— &lt; plain"


def test_dropped_elements_that_nest(spark):
    pages = {
        "a<nav>b<nav>c</nav>d</nav>e": "ae",
        "a<NAV x='1'>b<form>c</nav>d</form>e": "ade",
        "<nav>a</nav>b<nav>c</nav>d": "bd",
        "a<nav>b<script>'</nav><nav>'</script>c</nav>d<nav>e</nav>f": "adf",
        "a<nav>b<!-- </nav> <nav> -->c</nav>d": "ad",
        "a<svg/>b<svg>c</svg>d": "abd",
        "a</nav>b<nav>c<nav>d</nav>e": "abce",
        "a<nav>b": "ab",
        "navy <navy>x<navy>y": "navy xy",
        "": "",
    }
    rows = spark.createDataFrame([(k,) for k in pages], "html string")
    assert {r.html: r.t for r in rows.select("html", T.html_to_text("html").alias("t")).collect()} == pages
    deep = "a" + "<nav>" * 5000 + "x" + "</nav>" * 5000 + "b"
    assert T.drop_nested(deep) == "ab" and T.drop_nested("<form>" * 3) == "<form>" * 3


def test_one_definition_for_each_mention(spark):
    entities = spark.createDataFrame([("e1", "fever")], "entity_id string, normalized_name string")
    dictionary = spark.createDataFrame([("fever", "Fever", "two", "b", 2), ("fever", "Fever", "one", "a", 1)], "normalized_term string, term string, definition_text string, source string, source_id int")
    assert [r.definition_text for r in extract.link_definitions(entities, dictionary).collect()] == ["one"]


def test_records_of_any_depth():
    from medgraph.sources import records

    deep = "[" * 300 + '"x"' + "]" * 300
    assert list(records.json_paragraphs(deep)) == ["x"]
    assert list(records.json_paragraphs('{"a": 1, "b": {"c": "d", "e": [{"f": null, "g": true}]}, "h": ""}')) == ["a: 1", "b\nc: d", "b > e\ng: yes"]
    assert list(records.xml_paragraphs("<r><a>1</a><s><t>x</t><p>prose</p></s><b>2</b></r>")) == ["a: 1\nb: 2", "t: x", "prose"]
    assert list(records.delimited_paragraphs("a,,c\n\n1,2,3,4\n,,\n5,,6\n", ",")) == ["a: 1\ncolumn 2: 2\nc: 3\ncolumn 4: 4", "a: 5\nc: 6"]
