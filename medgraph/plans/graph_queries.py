"""Registered queries: extraction, linking, graph tables, resumed runs, retrieval and streams."""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators import extract, graph, retrieve
from ..sources.scratch import shared_dir, stored
from ..sources.snapshots import Snapshots
from ..streaming import ingest as stream
from ..streaming import ledger
from .fixtures import Tables, with_ctes
from .text_queries import TERM_CTE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


# --- extraction and linking


@query(with_ctes("entities") + "SELECT * FROM entities")
def dictionary_entities(t: Tables) -> DataFrame:
    return t.entities()


@query(with_ctes("chunk_tokens", "item_tokens").rstrip() + """,
long_terms AS (SELECT array_to_string(tokens[1:m], ' ') AS term, (['symptom', 'diagnosis', 'treatment'])[min(item_id) % 3 + 1] AS kind, m FROM item_tokens, (SELECT unnest([3, 6, 9]) AS m) WHERE len(tokens) >= m GROUP BY ALL),
places AS (SELECT doc_id, chunk_id, tokens, unnest(range(1, len(tokens) + 1)) AS i FROM chunk_tokens)
SELECT doc_id, chunk_id, (i - 1)::INT AS pos, m AS n, term AS name, min(kind) AS entity_type FROM places JOIN long_terms ON tokens[i] = string_split(term, ' ')[1] AND array_to_string(tokens[i : i + m - 1], ' ') = term AND i + m - 1 <= len(tokens) GROUP BY ALL""")
def dictionary_long_terms(t: Tables) -> DataFrame:
    """Terms of 3, 6 and 9 tokens, each the start of the next."""
    tokens = t.raw("benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    kinds = F.array(F.lit("symptom"), F.lit("diagnosis"), F.lit("treatment"))
    starts = tokens.select("item_id", "tokens", F.explode(F.array(F.lit(3), F.lit(6), F.lit(9))).alias("m")).filter("size(tokens) >= m")
    terms = starts.groupBy(F.array_join(F.slice("tokens", F.lit(1), F.col("m")), " ").alias("normalized_term")).agg(F.element_at(kinds, (F.min("item_id") % 3 + 1).cast("int")).alias("semantic_type"))
    return extract.dictionary_entities(t.chunks(), terms).select("doc_id", "chunk_id", "pos", "n", "name", "entity_type")


@query(with_ctes("relations") + "SELECT * FROM relations")
def rule_relations(t: Tables) -> DataFrame:
    return t.relations()


@query(with_ctes("entities", "definitions") + "SELECT e.entity_id, e.normalized_name, d.definition_text, d.source_id FROM entities e LEFT JOIN definitions d ON e.normalized_name = d.normalized_term")
def link_definitions(t: Tables) -> DataFrame:
    return extract.link_definitions(t.entities(), t.definitions()).select("entity_id", "normalized_name", "definition_text", "source_id")


@query(with_ctes("entities", "definitions") + "SELECT normalized_name, count(*) AS mentions FROM entities WHERE normalized_name NOT IN (SELECT normalized_term FROM definitions) GROUP BY 1")
def undefined_entities(t: Tables) -> DataFrame:
    return extract.undefined_entities(t.entities(), t.definitions())


@query(with_ctes("dictionary") + "SELECT normalized_term, source, term, CASE WHEN source_id % 2 = 0 THEN 'New ' ELSE '' END || definition_text AS definition_text, source_id, semantic_type, CASE WHEN source_id % 2 = 0 THEN 2 ELSE 1 END AS seq FROM dictionary")
def merge_definitions(t: Tables) -> DataFrame:
    old = t.dictionary().withColumn("seq", F.lit(1))
    new = t.dictionary().filter("source_id % 2 = 0").withColumn("definition_text", F.concat(F.lit("New "), "definition_text")).withColumn("seq", F.lit(2))
    return extract.merge_definitions(old, new)


@query(with_ctes("relations") + "SELECT DISTINCT source_id, target_id, relation_type FROM relations")
def merge_relations(t: Tables) -> DataFrame:
    r = t.relations()
    return extract.merge_relations(r.unionByName(r))


_REPLIES = """ranked AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY pos, n) - 1 AS k, count(*) OVER (PARTITION BY chunk_id) AS m, doc_id + "order" AS z FROM entities),
parsed AS (SELECT sha256(chunk_id || chr(1) || k) AS entity_id, doc_id, chunk_id, k::INT AS pos, name, normalized_name, CASE WHEN n = 2 THEN 'other' ELSE entity_type END AS entity_type, m FROM ranked WHERE z % 7 <> 3)"""


@query(with_ctes("entities") + """SELECT DISTINCT chunk_id, (doc_id + "order") % 7 <> 3 AS parsed FROM entities""")
def parse_replies(t: Tables) -> DataFrame:
    return t.replies().select("chunk_id", extract.reply_object().isNotNull().alias("parsed"))


@query(with_ctes("entities").rstrip() + ",\n" + _REPLIES + " SELECT * EXCLUDE (m) FROM parsed")
def parse_entities(t: Tables) -> DataFrame:
    return extract.parse_entities(t.replies())


@query(with_ctes("entities").rstrip() + ",\n" + _REPLIES + """, ends AS (SELECT chunk_id, max(CASE WHEN pos = 0 THEN normalized_name END) AS s, max(CASE WHEN pos = m - 1 THEN normalized_name END) AS t FROM parsed GROUP BY chunk_id),
lasts AS (SELECT chunk_id, normalized_name, arg_max(entity_id, pos) AS id FROM parsed GROUP BY ALL)
SELECT e.chunk_id, 0 AS pos, a.id AS source_id, b.id AS target_id, 'related_to' AS relation_type FROM ends e JOIN lasts a ON a.chunk_id = e.chunk_id AND a.normalized_name = s JOIN lasts b ON b.chunk_id = e.chunk_id AND b.normalized_name = t WHERE a.id <> b.id""")
def parse_relations(t: Tables) -> DataFrame:
    return extract.parse_relations(t.replies(), extract.parse_entities(t.replies()))


@query(with_ctes("entities") + """SELECT DISTINCT chunk_id FROM entities WHERE (doc_id + "order") % 7 = 3""")
def failed_chunks(t: Tables) -> DataFrame:
    return extract.failed_chunks(t.replies()).select("chunk_id")


_TWICE = """twice AS (SELECT doc_id, "order", text FROM chunks UNION ALL SELECT doc_id, "order" + 100000, text FROM chunks WHERE doc_id % 2 = 0)"""


def _twice(t: Tables) -> DataFrame:
    c = t.chunks()
    return c.unionByName(c.filter("doc_id % 2 = 0").withColumn("order", F.col("order") + 100000))


@query(with_ctes("chunks").rstrip() + f""",\n{_TWICE} SELECT doc_id, "order", min("order") OVER w AS source_order, "order" <> min("order") OVER w AS reused FROM twice WINDOW w AS (PARTITION BY doc_id, text)""")
def reuse_extractions(t: Tables) -> DataFrame:
    return extract.reuse_plan(_twice(t))


def _first_word(text: str) -> str:
    """An extractor for the queries: the chunk's first word, as a reply."""
    return json.dumps({"entities": [{"name": text.split(None, 1)[0]}]})


@query(with_ctes("chunks").rstrip() + f""",\n{_TWICE} SELECT doc_id, "order", "order" <> min("order") OVER (PARTITION BY doc_id, text) AS reused, string_split_regex(text, '\\s+')[1] AS name FROM twice""")
def extract_batch(t: Tables) -> DataFrame:
    c = _twice(t).withColumn("chunk_id", F.sha2(F.concat_ws("/", "doc_id", "order"), 256))
    got = extract.extract_batch(c, _first_word, concurrency=8)
    return got.select("doc_id", "order", "reused", F.get_json_object("reply", "$.entities[0].name").alias("name"))


@query(with_ctes("chunks") + """SELECT DISTINCT sha256(text) AS text_key, string_split_regex(text, '\\s+')[1] AS name FROM chunks""")
def stored_replies(t: Tables) -> DataFrame:
    """Two runs over one store of replies: half of the documents, then all."""
    store, chunks = f"{shared_dir(t.spark)}/replies-{uuid.uuid4().hex}", t.stored("chunks")
    for part in (chunks.filter("doc_id % 2 = 0"), chunks):
        extract.extract_batch(part, _first_word, concurrency=8, across_documents=True, store=store, extractor="first_word", waves=2)
    return Snapshots(t.spark, store).read("first_word").select("text_key", F.get_json_object("reply", "$.entities[0].name").alias("name"))


# --- graph tables


@query(with_ctes("chunks", "entities", "relations", "definitions", "src") + """SELECT s.doc_id, (SELECT count(*) FROM chunks x WHERE x.doc_id = s.doc_id) AS chunk_count, (SELECT count(*) FROM entities x WHERE x.doc_id = s.doc_id) AS entity_count,
(SELECT count(*) FROM relations x WHERE x.doc_id = s.doc_id) AS relation_count, (SELECT count(DISTINCT (source_id, target_id, relation_type)) FROM relations x WHERE x.doc_id = s.doc_id) AS stored_relations,
(SELECT count(*) FROM entities x JOIN definitions d ON x.normalized_name = d.normalized_term WHERE x.doc_id = s.doc_id) AS definitions_matched,
(SELECT count(*) FROM entities x WHERE x.doc_id = s.doc_id AND x.normalized_name NOT IN (SELECT normalized_term FROM definitions)) AS definitions_missing FROM src s""")
def ingest_stats(t: Tables) -> DataFrame:
    return graph.ingest_stats(t.documents(), t.stored("chunks"), t.stored("entities"), t.stored("relations"), t.definitions())


@query(with_ctes("chunks", "entities", "relations", "definitions") + """, e AS (SELECT chunk_id, count(*) AS entities, count(DISTINCT CASE WHEN normalized_name IN (SELECT normalized_term FROM definitions) THEN entity_id END) AS defined FROM entities GROUP BY 1),
r AS (SELECT chunk_id, count(DISTINCT (source_id, target_id, relation_type)) AS relations FROM relations GROUP BY 1)
SELECT c.chunk_id, c.doc_id, c."order", coalesce(entities, 0) AS entities, coalesce(relations, 0) AS relations, coalesce(defined, 0) AS defined FROM chunks c LEFT JOIN e USING (chunk_id) LEFT JOIN r USING (chunk_id)""".replace(", e AS", ", e AS", 1))
def chunk_stats(t: Tables) -> DataFrame:
    return graph.chunk_stats(t.stored("chunks"), t.stored("entities"), t.stored("relations"), t.definitions())


ORACLES["chunk_stats"] = ORACLES["chunk_stats"].replace(")\n, e AS", "),\ne AS", 1)


@query(with_ctes("chunks", "src") + """SELECT s.doc_id, CASE WHEN s.doc_id % 2 = 0 THEN s.doc_id ELSE (SELECT count(*) FROM chunks c WHERE c.doc_id = s.doc_id) END AS chunk_count FROM src s""")
def stats_or_recount(t: Tables) -> DataFrame:
    docs = t.documents().withColumn("chunk_count", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    again = graph._with_counts(t.documents().select("doc_id"), "doc_id", [graph._count(t.chunks(), "doc_id", "chunk_count")])
    return graph.stats_or_recount(docs, again, ["chunk_count"])


@query(with_ctes("chunks", "entities", "definitions", "src") + """SELECT s.doc_id, filename, doc_type, c.chunk_id, c."order", c.text, e.entity_id, e.name, e.entity_type, e.normalized_name, d.definition_text
FROM src s JOIN chunks c ON c.doc_id = s.doc_id LEFT JOIN entities e ON e.chunk_id = c.chunk_id LEFT JOIN definitions d ON d.normalized_term = e.normalized_name""")
def document_graph(t: Tables) -> DataFrame:
    return graph.document_graph(t.documents(), t.stored("chunks"), t.stored("entities"), t.definitions())


@query(with_ctes("entities", "relations") + """SELECT r.doc_id, a.name AS source_name, relation_type, b.name AS target_name FROM (SELECT DISTINCT doc_id, source_id, target_id, relation_type FROM relations) r
JOIN entities a ON a.entity_id = source_id JOIN entities b ON b.entity_id = target_id""")
def document_relations(t: Tables) -> DataFrame:
    return graph.document_relations(t.stored("entities"), t.stored("relations"))


@query(with_ctes("chunks", "entities", "relations", "src").rstrip() + """,
e AS (SELECT c.doc_id, string_agg(c."order" || ':' || coalesce(n, 0), ' ' ORDER BY c."order") AS entities FROM chunks c LEFT JOIN (SELECT chunk_id, count(*) AS n FROM entities GROUP BY 1) USING (chunk_id) GROUP BY 1),
r AS (SELECT x.doc_id, string_agg(a.name || '>' || relation_type || '>' || b.name, ' ' ORDER BY a.name, relation_type, b.name) AS relations FROM (SELECT DISTINCT doc_id, source_id, target_id, relation_type FROM relations) x JOIN entities a ON a.entity_id = source_id JOIN entities b ON b.entity_id = target_id GROUP BY 1)
SELECT doc_id, filename, doc_type, e.entities, coalesce(r.relations, '') AS relations FROM src JOIN e USING (doc_id) LEFT JOIN r USING (doc_id)""")
def nested_graph(t: Tables) -> DataFrame:
    """The nested dump of every document, its arrays written as text."""
    flat = graph.document_graph(t.documents(), t.stored("chunks"), t.stored("entities"), t.definitions())
    rows = graph.nested_graph(flat, graph.document_relations(t.stored("entities"), t.stored("relations")))
    entities = F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["order"], F.size(c["entities"]))), " ")
    relations = F.array_join(F.transform("relations", lambda r: F.concat_ws(">", r["source_name"], r["relation_type"], r["target_name"])), " ")
    return rows.select("doc_id", "filename", "doc_type", entities.alias("entities"), relations.alias("relations"))


@query(with_ctes("src") + "SELECT doc_id, filename, doc_type, ingested_at, CASE WHEN ingestion_complete = false THEN 'incomplete' ELSE 'complete' END AS status FROM src ORDER BY ingested_at DESC LIMIT 50")
def recent_documents(t: Tables) -> DataFrame:
    return graph.recent_documents(t.documents()).withColumn("ingested_at", F.col("ingested_at").cast("timestamp_ntz"))


@query(with_ctes("src") + "SELECT doc_id, source_hash, doc_type, row_number() OVER (PARTITION BY source_hash, doc_type ORDER BY ingested_at)::INT AS place FROM src")
def documents_by_hash(t: Tables) -> DataFrame:
    return graph.documents_by_hash(t.documents())


@query(with_ctes("src") + """, x AS (SELECT *, coalesce(ingestion_complete, true) AS done FROM src),
y AS (SELECT *, min(CASE WHEN done THEN ingested_at END) OVER w AS first_done, max(CASE WHEN NOT done THEN ingested_at END) OVER w AS last_open FROM x WINDOW w AS (PARTITION BY source_hash, doc_type))
SELECT doc_id, CASE WHEN first_done IS NOT NULL AND NOT done THEN 'delete' WHEN first_done IS NOT NULL THEN CASE WHEN ingested_at = first_done THEN 'keep' ELSE 'leave' END WHEN ingested_at = last_open THEN 'resume' ELSE 'delete' END AS action FROM y""")
def duplicate_actions(t: Tables) -> DataFrame:
    return graph.duplicate_actions(t.documents())


ORACLES["duplicate_actions"] = ORACLES["duplicate_actions"].replace(")\n, x AS", "),\nx AS", 1)


@query(with_ctes("src") + "SELECT doc_id FROM src b WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM src s WHERE s.doc_id % 3 = 0 AND coalesce(s.ingestion_complete, true) AND s.source_hash = b.source_hash AND s.doc_type = b.doc_type)")
def new_documents(t: Tables) -> DataFrame:
    docs = t.documents()
    return graph.new_documents(docs.filter("doc_id % 3 <> 0"), docs.filter("doc_id % 3 = 0")).select("doc_id")


_OLD = """old AS (SELECT c.*, CASE WHEN c.doc_id % 9 = 3 THEN NULL ELSE (c."order" + c.doc_id) % 3 <> 0 END AS extracted, CASE WHEN c."order" % 5 = 4 THEN 'changed' ELSE text END AS old_text
FROM chunks c JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY 1) USING (doc_id) WHERE c.doc_id % 3 = 0 AND c."order" < n / 2 + 1),
flags AS (SELECT doc_id, bool_or(extracted IS NOT NULL) AS flagged, max("order") AS last FROM old GROUP BY 1),
finished AS (SELECT o.* FROM old o JOIN flags USING (doc_id) WHERE CASE WHEN flagged THEN coalesce(extracted, false) ELSE "order" < last END)"""


def _old(t: Tables) -> DataFrame:
    c = t.chunks().filter("doc_id % 3 = 0")
    n = c.groupBy("doc_id").agg(F.count("*").alias("n"))
    flag = F.when(F.col("doc_id") % 9 != 3, (F.col("order") + F.col("doc_id")) % 3 != 0)
    changed = F.when(F.col("order") % 5 == 4, "changed").otherwise(F.col("text"))
    return c.join(n, "doc_id").filter(F.col("order") < F.col("n") / 2 + 1).select("doc_id", "chunk_id", "order", changed.alias("text"), flag.alias("extracted"))


@query(with_ctes("chunks").rstrip() + f',\n{_OLD} SELECT doc_id, "order" FROM finished')
def finished_chunks(t: Tables) -> DataFrame:
    return graph.finished_chunks(_old(t)).select("doc_id", "order")


@query(with_ctes("chunks").rstrip() + f""",\n{_OLD}, new AS (SELECT * FROM chunks WHERE doc_id % 3 = 0),
same AS (SELECT doc_id, "order" FROM finished f JOIN new n USING (doc_id, "order") WHERE f.old_text = n.text)
SELECT doc_id, "order", 'reuse' AS action FROM same
UNION ALL SELECT doc_id, "order", 'delete' FROM (SELECT doc_id, "order" FROM old EXCEPT SELECT * FROM same)
UNION ALL SELECT doc_id, "order", 'todo' FROM (SELECT doc_id, "order" FROM new EXCEPT SELECT * FROM same)""")
def resume_plan(t: Tables) -> DataFrame:
    return graph.resume_plan(_old(t), t.chunks().filter("doc_id % 3 = 0"))


def _rows_of(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, id) of what documents, chunks, entities and edges hold."""
    ids = {"documents": F.col("doc_id").cast("string"), "chunks": F.col("chunk_id"), "entities": F.col("entity_id"), "relations": F.concat_ws(" ", "source_id", "target_id", "relation_type")}
    return functools.reduce(DataFrame.unionByName, (t.select(F.lit(name).alias("kind"), ids[name].alias("id")) for name, t in tables.items()))


_EDGE_ID = "source_id || ' ' || target_id || ' ' || relation_type"


@query(with_ctes("src", "relations") + f"""SELECT 'documents' AS kind, doc_id::VARCHAR AS id FROM src WHERE doc_id % 5 <> 0
UNION ALL SELECT 'chunks', chunk_id FROM chunks WHERE doc_id % 5 <> 0
UNION ALL SELECT 'entities', entity_id FROM entities WHERE doc_id % 5 <> 0
UNION ALL SELECT 'relations', {_EDGE_ID} FROM relations WHERE doc_id % 5 <> 0""")
def delete_documents(t: Tables) -> DataFrame:
    tables = {"documents": t.documents(), "chunks": t.stored("chunks"), "entities": t.stored("entities"), "relations": t.stored("relations")}
    return _rows_of(graph.delete_documents(t.documents().filter("doc_id % 5 = 0"), tables))


@query(with_ctes("relations") + f"""SELECT 'chunks' AS kind, chunk_id AS id FROM chunks WHERE "order" % 2 <> 1
UNION ALL SELECT 'entities', entity_id FROM entities WHERE "order" % 2 <> 1
UNION ALL SELECT 'relations', {_EDGE_ID} FROM relations WHERE source_id NOT IN (SELECT entity_id FROM entities WHERE "order" % 2 = 1) AND target_id NOT IN (SELECT entity_id FROM entities WHERE "order" % 2 = 1)""")
def delete_chunks(t: Tables) -> DataFrame:
    left = graph.delete_chunks(t.stored("chunks").filter("`order` % 2 = 1"), t.stored("chunks"), t.stored("entities"), t.stored("relations"))
    return _rows_of(dict(zip(("chunks", "entities", "relations"), left, strict=True)))


@query(with_ctes("chunks") + "SELECT chunk_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE text END AS text FROM chunks")
def upsert_chunks(t: Tables) -> DataFrame:
    c = t.chunks().select("chunk_id", "doc_id", "text")
    return graph.upsert(c, c.filter("doc_id % 3 = 0").withColumn("text", F.lit("again")), ["chunk_id"])


@query("""WITH e AS (SELECT user_id AS job, ts, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status, event_id FROM events),
l AS (SELECT job, arg_max(status, (ts, event_id)) AS status, min(ts) AS created_at, max(ts) AS updated_at FROM e GROUP BY job)
SELECT * FROM l WHERE status IN ('queued', 'running') OR updated_at >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR""")
def run_ledger(t: Tables) -> DataFrame:
    return graph.run_ledger(t.ledger()).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})


# --- retrieval

_Q = f"""question_tokens AS (SELECT item_id AS question_id, regexp_extract_all(regexp_replace(lower(text), '(?i)\\bp-\\d{{4,}}\\b', ' ', 'g'), '[a-z0-9][a-z0-9''\\-]*') AS t FROM benchmark),
{TERM_CTE.split(",", 1)[1][TERM_CTE.split(",", 1)[1].index("stops AS"):].split("grams AS")[0]}
question_grams AS (SELECT question_id, n, unnest(list_transform(range(1, greatest(len(t) - n + 2, 1)), lambda i: t[i:i + n - 1])) AS g FROM question_tokens, (SELECT unnest([1, 2, 3, 4]) AS n)),
terms AS (SELECT DISTINCT question_id, array_to_string(g, ' ') AS term FROM question_grams WHERE g[1] NOT IN (SELECT w FROM stops) AND g[len(g)] NOT IN (SELECT w FROM stops) AND (n > 1 OR length(g[1]) >= 3)),
direct AS (SELECT question_id, term AS name FROM terms UNION SELECT question_id, d.normalized_name FROM terms JOIN defined_as d ON d.normalized_term = term),
related AS (SELECT DISTINCT question_id, b AS name FROM direct JOIN both_edges ON a = name EXCEPT SELECT * FROM direct),
weighted AS (SELECT *, 1.0 AS weight FROM direct UNION ALL SELECT *, 0.5 FROM related),
scores AS (SELECT question_id, chunk_id, doc_id, "order", sum(weight)::DOUBLE AS score FROM weighted JOIN mentions USING (name) GROUP BY ALL),
ranked AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, "order")::INT AS number, chunk_id, doc_id, "order", score FROM scores QUALIFY number <= 6)"""
_SEARCH = with_ctes("mentions", "both_edges", "defined_as").rstrip() + ",\n" + _Q


def _direct(t: Tables) -> DataFrame:
    t.stored("entities")
    return retrieve.direct_names(retrieve.terms_of(t.questions()), retrieve.defined_names(t.defined_as()))


@query(with_ctes("defined_as") + "SELECT * FROM defined_as")
def defined_as_edges(t: Tables) -> DataFrame:
    return t.defined_as()


@query(_SEARCH + " SELECT question_id, name FROM direct")
def direct_names(t: Tables) -> DataFrame:
    return _direct(t)


@query(_SEARCH + " SELECT question_id, name FROM related")
def related_names(t: Tables) -> DataFrame:
    direct = _direct(t)
    return retrieve.related_names(direct, retrieve.name_edges(t.stored("entities"), t.stored("relations")))


@query(_SEARCH + """ SELECT question_id, chunk_id, doc_id, "order", count(*) AS hits FROM direct JOIN mentions USING (name) GROUP BY ALL""")
def mention_counts(t: Tables) -> DataFrame:
    direct = _direct(t)
    return retrieve.mention_counts(direct, retrieve.mentions(t.stored("chunks"), t.stored("entities")))


@query(_SEARCH + " SELECT * FROM scores")
def chunk_scores(t: Tables) -> DataFrame:
    direct = _direct(t)
    related = retrieve.related_names(direct, retrieve.name_edges(t.stored("entities"), t.stored("relations")))
    return retrieve.chunk_scores(direct, related, retrieve.mentions(t.stored("chunks"), t.stored("entities")))


def _ranked(t: Tables) -> DataFrame:
    return retrieve.search(retrieve.terms_of(t.questions()), t.stored("chunks"), t.stored("entities"), t.stored("relations"), t.defined_as())


@query(_SEARCH + " SELECT * FROM ranked")
def search_topk(t: Tables) -> DataFrame:
    return _ranked(t)


@query(_SEARCH + " SELECT * FROM ranked")
def search_postings(t: Tables) -> DataFrame:
    """The same rows with upper bounds, so that frequent names are looked up for chunks that can still enter only."""
    direct = stored(_direct(t))
    names = retrieve.weighted_names(direct, retrieve.related_names(direct, retrieve.name_edges(t.stored("entities"), t.stored("relations"))))
    return retrieve.search_postings(names, stored(retrieve.mentions(t.stored("chunks"), t.stored("entities"))), cut=stored)


@query(_SEARCH + """ SELECT question_id, number, r.chunk_id, r.doc_id, r."order", score, c.text, s.doc_type, CASE WHEN s.doc_type = 'patient_record' THEN 'Patient ' || s.pseudonym ELSE s.filename END AS source_label FROM ranked r JOIN chunks c USING (chunk_id) JOIN src s ON s.doc_id = r.doc_id""")
def hydrate_chunks(t: Tables) -> DataFrame:
    return retrieve.hydrate(_ranked(t), t.documents(), t.stored("chunks"))


@query(_SEARCH + """, sources AS (SELECT question_id, string_agg('[' || number || '] ' || CASE WHEN s.doc_type = 'patient_record' THEN 'Patient ' || s.pseudonym ELSE s.filename END || chr(10) || CASE WHEN length(c.text) > 2000 THEN substr(c.text, 1, 2000) || ' …' ELSE c.text END, chr(10) || chr(10) ORDER BY number) AS blocks
FROM ranked r JOIN chunks c USING (chunk_id) JOIN src s ON s.doc_id = r.doc_id GROUP BY question_id)
SELECT question_id, 'Sources:' || chr(10) || chr(10) || blocks || chr(10) || chr(10) || 'Question: ' || text AS prompt FROM sources JOIN benchmark ON item_id = question_id""")
def build_prompts(t: Tables) -> DataFrame:
    return retrieve.build_prompts(t.questions(), retrieve.hydrate(_ranked(t), t.documents(), t.stored("chunks")))


@query(_SEARCH + """, e AS (SELECT chunk_id, string_agg(name || ':' || entity_type || ':' || coalesce(definition_text, ''), ' | ' ORDER BY name, entity_type, definition_text) AS entities FROM entities LEFT JOIN definitions ON normalized_term = normalized_name GROUP BY 1)
SELECT question_id, number, chunk_id, c."order" // 3 + 1 AS page_number, e.entities FROM ranked JOIN chunks c USING (chunk_id) LEFT JOIN e USING (chunk_id)""")
def sources_with_entities(t: Tables) -> DataFrame:
    """Ranked chunks with their page (three chunks a page here), entities and definitions, the entities as text."""
    paged = t.stored("chunks").withColumn("page_number", F.floor(F.col("order") / 3) + 1)
    rows = retrieve.with_entities(retrieve.hydrate(_ranked(t), t.documents(), paged), t.stored("entities"), t.definitions())
    label = lambda e: F.concat_ws(":", e["name"], e["entity_type"], F.coalesce(e["definition"]["definition_text"], F.lit("")))
    return rows.select("question_id", "number", "chunk_id", "page_number", F.array_join(F.transform(F.array_sort("entities"), label), " | ").alias("entities"))


@query(_SEARCH + " SELECT question_id, number, chunk_id FROM ranked WHERE number IN (1, 3)")
def resolve_citations(t: Tables) -> DataFrame:
    answers = t.questions().select("question_id", F.concat(F.lit("As said [1][3], and [99]: "), "question").alias("answer"))
    return retrieve.resolve_citations(answers, _ranked(t))


@query(_SEARCH + f""" SELECT item_id AS question_id, '{retrieve.NO_SOURCES.replace("'", "''")}' AS answer FROM benchmark WHERE item_id NOT IN (SELECT question_id FROM ranked WHERE question_id % 2 = 0)""")
def no_source_answers(t: Tables) -> DataFrame:
    return retrieve.no_source_answers(t.questions(), _ranked(t).filter("question_id % 2 = 0"))


@query(_SEARCH + " SELECT question_id, term FROM terms UNION SELECT item_id, 'fever ' || item_id FROM benchmark")
def add_terms(t: Tables) -> DataFrame:
    return retrieve.add_terms(t.questions().withColumn("translated", F.array(F.concat(F.lit("fever "), F.col("question_id").cast("string")))))


_TURNS = f"""WITH {TERM_CTE},
user_turns AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user')"""


@query(_TURNS + """ SELECT u.conv_id || '/' || u.turn AS question_id, coalesce((SELECT string_agg(DISTINCT term, '|' ORDER BY term) FROM turn_terms x JOIN user_turns v USING (conv_id, turn) WHERE v.conv_id = u.conv_id AND v.k BETWEEN u.k - 2 AND u.k - 1), '') AS earlier,
CASE WHEN u.conv_id % 5 = 0 THEN 'P-' || CASE WHEN u.conv_id * 4 < 10000 THEN lpad((u.conv_id * 4)::VARCHAR, 4, '0') ELSE (u.conv_id * 4)::VARCHAR END ELSE '' END AS pseudonyms FROM user_turns u""")
def follow_up_context(t: Tables) -> DataFrame:
    turns = retrieve.user_turns(t.conversations())
    return turns.select("question_id", F.array_join(F.array_sort("earlier_terms"), "|").alias("earlier"), F.array_join("pseudonyms", ",").alias("pseudonyms"))


@query("""WITH q AS (SELECT conv_id || '/' || turn AS question_id, conv_id * 4 AS doc_id FROM conversations WHERE role = 'user' AND conv_id % 5 = 0)
SELECT question_id, d.doc_id FROM q LEFT JOIN documents d ON d.doc_id = q.doc_id AND d.doc_id % 4 = 0""")
def pseudonym_scope(t: Tables) -> DataFrame:
    return retrieve.pseudonym_scope(retrieve.user_turns(t.conversations()), t.documents())


@query(with_ctes("open_chunks") + """, q AS (SELECT conv_id || '/' || turn AS question_id, unnest([conv_id * 4, conv_id * 4 + 20]) AS doc_id FROM conversations WHERE role = 'user' AND conv_id % 5 = 0),
early AS (SELECT question_id, chunk_id, c.doc_id, "order" FROM q JOIN open_chunks c ON c.doc_id = q.doc_id QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY "order", c.doc_id) <= 6)
SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY doc_id, "order")::INT AS number, chunk_id, doc_id, "order", 0.0::DOUBLE AS score FROM early""")
def pseudonym_listing(t: Tables) -> DataFrame:
    turns = retrieve.user_turns(t.conversations()).filter("conv_id % 5 = 0")
    two = turns.withColumn("pseudonyms", F.concat("pseudonyms", F.array(F.format_string("P-%04d", F.col("conv_id") * 4 + 20))))
    return retrieve.pseudonym_listing(retrieve.pseudonym_scope(two, t.documents()), t.chunks())


def _pass(name: str, terms: str) -> str:
    """Ranked chunks of one pass: its terms, one hop further, in scope."""
    return f"""{name}_direct AS (SELECT question_id, term FROM {terms} UNION SELECT question_id, d.normalized_name FROM {terms} JOIN defined_as d ON d.normalized_term = term),
{name}_related AS (SELECT DISTINCT question_id, b AS name FROM {name}_direct JOIN both_edges ON a = term EXCEPT SELECT question_id, term FROM {name}_direct),
{name}_scores AS (SELECT w.question_id, m.chunk_id, m.doc_id, m."order", sum(weight)::DOUBLE AS score FROM (SELECT question_id, term AS name, 1.0 AS weight FROM {name}_direct UNION ALL SELECT question_id, name, 0.5 FROM {name}_related) w
JOIN mentions m USING (name) JOIN asked q USING (question_id) WHERE q.patient IS NULL OR (q.patient = m.doc_id AND m.doc_id % 4 = 0) GROUP BY ALL),
{name} AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id, "order")::INT AS number, chunk_id, doc_id, "order", score FROM {name}_scores QUALIFY number <= 6)"""


_CONV = (
    with_ctes("mentions", "both_edges", "defined_as").rstrip() + ",\n" + TERM_CTE + """,
asked AS (SELECT conv_id || '/' || turn AS question_id, conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, CASE WHEN conv_id % 5 = 0 THEN conv_id * 4 END AS patient FROM conversations WHERE role = 'user'),
own_terms AS (SELECT question_id, term FROM turn_terms JOIN asked USING (conv_id, turn)),
""" + _pass("own", "own_terms") + """,
bare AS (SELECT r.question_id, row_number() OVER (PARTITION BY r.question_id ORDER BY c."order")::INT AS number, c.chunk_id, c.doc_id, c."order", 0.0::DOUBLE AS score FROM asked r JOIN open_chunks c ON c.doc_id = r.patient AND c.doc_id % 4 = 0
WHERE r.question_id NOT IN (SELECT question_id FROM own_terms) QUALIFY number <= 6),
rest AS (SELECT * FROM asked WHERE question_id NOT IN (SELECT question_id FROM own) AND question_id NOT IN (SELECT question_id FROM bare)),
back_terms AS (SELECT DISTINCT r.question_id, x.term FROM rest r JOIN asked v ON v.conv_id = r.conv_id AND v.k BETWEEN r.k - 2 AND r.k - 1 JOIN turn_terms x ON x.conv_id = v.conv_id AND x.turn = v.turn),
more_terms AS (SELECT * FROM back_terms UNION SELECT o.question_id, o.term FROM own_terms o WHERE o.question_id IN (SELECT question_id FROM back_terms)),
""" + _pass("more", "more_terms") + """,
patient AS (SELECT r.question_id, row_number() OVER (PARTITION BY r.question_id ORDER BY c."order")::INT AS number, c.chunk_id, c.doc_id, c."order", 0.0::DOUBLE AS score FROM rest r JOIN open_chunks c ON c.doc_id = r.patient AND c.doc_id % 4 = 0
WHERE r.question_id NOT IN (SELECT question_id FROM more) QUALIFY number <= 6),
answers AS (SELECT *, 'own' AS route FROM own UNION ALL SELECT *, 'earlier' FROM more UNION ALL SELECT *, 'patient' FROM bare UNION ALL SELECT *, 'patient' FROM patient)"""
)


for _name in ("pseudonym_listing", "build_prompts"):
    ORACLES[_name] = ORACLES[_name].replace(")\n, q AS", "),\nq AS", 1)


@query(_CONV + """ SELECT question_id, number, chunk_id, doc_id, "order", score, route FROM answers""")
def retrieve_conversations(t: Tables) -> DataFrame:
    return retrieve.retrieve_conversations(retrieve.user_turns(t.conversations()), t.documents(), t.stored("chunks"), t.stored("entities"), t.stored("relations"), t.defined_as(), cut=stored)


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations)
SELECT u.conv_id, u.turn, m.place::INT AS place, m.role, m.text AS content FROM n u JOIN n m ON m.conv_id = u.conv_id AND m.place BETWEEN u.place - 6 AND u.place - 1 WHERE u.role = 'user' AND m.role IN ('user', 'assistant') AND m.text <> ''""")
def history_messages(t: Tables) -> DataFrame:
    return retrieve.history_messages(t.raw("conversations"))


@query(_CONV + """, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations),
sources AS (SELECT question_id, string_agg('[' || number || '] ' || CASE WHEN s.doc_type = 'patient_record' THEN 'Patient ' || s.pseudonym ELSE s.filename END || ', page ' || (c."order" // 3 + 1) || chr(10) || CASE WHEN length(c.text) > 2000 THEN substr(c.text, 1, 2000) || ' …' ELSE c.text END, chr(10) || chr(10) ORDER BY number) AS blocks
FROM answers r JOIN chunks c USING (chunk_id) JOIN src s ON s.doc_id = r.doc_id GROUP BY question_id),
told AS (SELECT u.conv_id || '/' || u.turn AS question_id, string_agg(m.role || '=' || m.text, chr(10) ORDER BY m.place) AS h FROM n u JOIN n m ON m.conv_id = u.conv_id AND m.place BETWEEN u.place - 6 AND u.place - 1 WHERE u.role = 'user' AND m.role IN ('user', 'assistant') AND m.text <> '' GROUP BY 1)
SELECT u.conv_id || '/' || u.turn AS question_id, 'system=Use the sources only.' || coalesce(chr(10) || h, '') || chr(10) || 'user=Sources:' || chr(10) || chr(10) || blocks || chr(10) || chr(10) || 'Question: ' || u.text AS messages
FROM n u JOIN sources s ON s.question_id = u.conv_id || '/' || u.turn LEFT JOIN told t ON t.question_id = s.question_id WHERE u.role = 'user'""")
def chat_messages(t: Tables) -> DataFrame:
    """All messages of each turn that has sources, as text; the conversations are those of the table."""
    raw = t.conversations()
    ranked = stored(retrieve.retrieve_conversations(retrieve.user_turns(raw), t.documents(), t.stored("chunks"), t.stored("entities"), t.stored("relations"), t.defined_as(), cut=stored))
    paged = t.stored("chunks").withColumn("page_number", F.floor(F.col("order") / 3) + 1)
    # earlier messages and questions are shown as they stand in the table, without the patient that the view adds
    rows = retrieve.chat_messages(t.raw("conversations"), retrieve.hydrate(ranked, t.documents(), paged), "Use the sources only.")
    return rows.select("question_id", F.array_join(F.transform("messages", lambda m: F.concat_ws("=", m["role"], m["content"])), "\n").alias("messages"))


# --- streams, run to the end of what is there


def _stream(t: Tables, name: str) -> tuple[DataFrame, str]:
    """The table as a stream, and a fresh folder that driver and executors share."""
    path = f"{t.sf_dir}/{name}.parquet*"  # a pattern, since a stream takes a folder but no single file
    schema = t.raw(name).schema
    return t.spark.readStream.schema(schema).parquet(path), f"{shared_dir(t.spark)}/stream-{uuid.uuid4().hex}"


def _run(stream_df: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    stream_df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{folder}/out").awaitTermination()
    return stream_df.sparkSession.read.schema(stream_df.schema).parquet(f"{folder}/out")


def _uploads(docs: DataFrame) -> DataFrame:
    patient = F.col("doc_id") % 4 == 0
    return docs.select("doc_id", F.when(patient, "patient_record").otherwise("textbook").alias("doc_type"), F.sha2("text", 256).alias("source_hash"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("ingested_at"), "text")


@query("SELECT sha256(text) AS source_hash, CASE WHEN doc_id % 4 = 0 THEN 'patient_record' ELSE 'textbook' END AS doc_type FROM documents GROUP BY ALL")
def stream_dedup(t: Tables) -> DataFrame:
    docs, folder = _stream(t, "documents")
    return _run(stream.drop_duplicates(_uploads(docs), "3650 days"), folder).select("source_hash", "doc_type")


@query(with_ctes("chunks", "entities", "relations", "src") + """, firsts AS (SELECT arg_min(doc_id, ingested_at) AS doc_id FROM src GROUP BY source_hash, doc_type)
SELECT 'document' AS kind, doc_id::VARCHAR AS id FROM firsts UNION ALL SELECT 'chunk', chunk_id FROM chunks SEMI JOIN firsts USING (doc_id) UNION ALL SELECT 'entity', entity_id FROM entities SEMI JOIN firsts USING (doc_id)
UNION ALL SELECT DISTINCT 'edge', source_id || ' ' || relation_type || ' ' || target_id FROM relations SEMI JOIN firsts USING (doc_id)""")
def stream_ingest(t: Tables) -> DataFrame:
    docs, folder = _stream(t, "documents")
    stream.stream_ingest(t.as_documents(docs).select("doc_id", "doc_type", "source_hash", "ingested_at", "text"), f"{folder}/store", f"{folder}/checkpoint", t.dictionary(), t.rules()).awaitTermination()
    log = Snapshots(t.spark, f"{folder}/store")
    rows = [("documents", "document", F.col("doc_id").cast("string")), ("chunks", "chunk", F.col("chunk_id")), ("entities", "entity", F.col("entity_id")), ("edges", "edge", F.concat_ws(" ", "source_id", "relation_type", "target_id"))]
    return functools.reduce(DataFrame.unionByName, (log.read(table).select(F.lit(kind).alias("kind"), key.alias("id")) for table, kind, key in rows))


ORACLES["stream_ingest"] = ORACLES["stream_ingest"].replace(")\n, firsts AS", "),\nfirsts AS", 1)


@query(with_ctes("chunks", "entities") + "SELECT 'chunk' AS kind, chunk_id AS id FROM chunks UNION ALL SELECT 'entity', entity_id FROM entities")
def snapshot_commits(t: Tables) -> DataFrame:
    """Chunks and entities of even and of odd documents as two changes, the first one tried twice."""
    log = Snapshots(t.spark, f"{shared_dir(t.spark)}/snapshots-{uuid.uuid4().hex}")
    for number in (0, 0, 1):
        log.commit({name: t.stored(name).filter(F.col("doc_id") % 2 == number) for name in ("chunks", "entities")}, "load", number)
    return log.read("chunks").select(F.lit("chunk").alias("kind"), F.col("chunk_id").alias("id")).unionByName(log.read("entities").select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id")))


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS window_start, CASE event_type WHEN 'signup' THEN 'queued' WHEN 'view' THEN 'running' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS status FROM events)
SELECT window_start, status, count(*) AS n FROM e WHERE window_start + INTERVAL 2 HOUR <= (SELECT max(ts) FROM events) GROUP BY window_start, status""")
def stream_progress(t: Tables) -> DataFrame:
    events, folder = _stream(t, "events")
    kind = F.col("event_type")
    status = F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running").when(kind == "purchase", "succeeded").otherwise("failed")
    counted = _run(stream.progress(events.select(F.col("ts").cast("timestamp").alias("ts"), status.alias("status"))), folder)
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(ORACLES["run_ledger"])
def stream_run_ledger(t: Tables) -> DataFrame:
    """The ledger as keyed state over a stream: the same jobs as ``run_ledger`` finds in the table."""
    events, folder = _stream(t, "events")
    ledger.stream_ledger(t.as_ledger(events), f"{folder}/changes", f"{folder}/checkpoint").awaitTermination()
    now = ledger.ledger(t.spark.read.option("basePath", f"{folder}/changes").parquet(f"{folder}/changes"))
    return now.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "updated_at")})
