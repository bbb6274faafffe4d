"""Views over the driver tables in the shape that the jobs expect, in Spark and (as common table expressions) in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import TOKEN
from ..operators import chunk, extract
from ..sources.scratch import stored

HEAD, TAIL = "Subjective:\n", "\nPlan:\nRest and fluids."


def spread(df: DataFrame) -> DataFrame:
    """A table of few row groups dealt to all cores, since its texts become many chunks; a large one as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


class Tables:
    """The tables of one folder, and what is derived from them, each built once and lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._stored: dict[str, DataFrame] = {}

    def stored(self, name: str) -> DataFrame:
        """A derived table that a query reads several times, written once: what a user's graph store would hold."""
        if name not in self._stored:
            self._stored[name] = stored(getattr(self, name)())
        return self._stored[name]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def documents(self) -> DataFrame:
        """src_documents: a fourth are patient records, with headers around the text."""
        return self.as_documents(spread(self.raw("documents")))

    @staticmethod
    def as_documents(raw: DataFrame) -> DataFrame:
        patient = F.col("doc_id") % 4 == 0
        return raw.select(
            "doc_id",
            F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"),
            F.when(patient, "patient_record").otherwise("textbook").alias("doc_type"),
            F.sha2("text", 256).alias("source_hash"),
            (F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id"))).alias("ingested_at"),
            F.when(patient, F.concat(F.lit("Name: Jane Doe\n" + HEAD), "text", F.lit(TAIL))).otherwise(F.col("text")).alias("text"),
            F.when(patient, F.format_string("P-%04d", F.col("doc_id"))).alias("pseudonym"),
            F.when(F.col("doc_id") % 3 == 0, F.col("doc_id") % 2 == 0).when(F.col("doc_id") % 3 == 1, True).alias("ingestion_complete"),
            (F.col("doc_id") % 8 == 0).alias("deidentified"),
        )

    def chunks(self) -> DataFrame:
        return chunk.chunk_documents(self.documents())

    def dictionary(self) -> DataFrame:
        """Terms from ``benchmark``: long tokens among an item's first eight, and its first two tokens."""
        tokens = self.raw("benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)).alias("tokens"))
        single = tokens.select("item_id", F.explode(F.filter(F.slice("tokens", 1, 8), lambda t: F.length(t) >= 5)).alias("term"))
        double = tokens.filter(F.size("tokens") >= 2).select("item_id", F.array_join(F.slice("tokens", 1, 2), " ").alias("term"))
        return (
            single.unionByName(double).groupBy("term").agg(F.min("item_id").alias("source_id"))
            .select(F.col("term").alias("normalized_term"), "term", F.concat(F.lit("Definition of "), "term").alias("definition_text"), F.lit("bench").alias("source"), "source_id", F.element_at(F.array(F.lit("symptom"), F.lit("diagnosis"), F.lit("treatment")), (F.col("source_id") % 3 + 1).cast("int")).alias("semantic_type"))
        )

    def definitions(self) -> DataFrame:
        """The part of the dictionary that has definitions."""
        return self.dictionary().filter("source_id % 4 <> 3")

    def rules(self) -> DataFrame:
        """The first two long tokens of an item, related by a type."""
        tokens = self.raw("benchmark").select("item_id", F.filter(F.slice(F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0)), 1, 8), lambda t: F.length(t) >= 5).alias("t"))
        # the optimizer may read a place before the filter on the size, so a place that is not there reads as null
        pairs = tokens.filter("size(t) >= 2 AND get(t, 0) <> get(t, 1)").select(F.get("t", 0).alias("source_term"), F.get("t", 1).alias("target_term"), F.when(F.col("item_id") % 2 == 0, "treats").otherwise("causes").alias("relation_type"))
        return pairs.distinct()

    def entities(self) -> DataFrame:
        return extract.dictionary_entities(self._stored.get("chunks", self.chunks()), self.dictionary())

    def relations(self) -> DataFrame:
        return extract.rule_relations(self._stored.get("entities", self.entities()), self.rules())

    def links(self) -> DataFrame:
        """A linker that knows preferred terms: names with a definition go to the first term of their item."""
        d = self.definitions()
        preferred = d.groupBy("source_id").agg(F.min("normalized_term").alias("preferred"))
        return d.join(preferred, "source_id").select(F.col("normalized_term").alias("normalized_name"), F.col("preferred").alias("normalized_term"), "source")

    def defined_as(self) -> DataFrame:
        return extract.defined_as(self._stored.get("entities", self.entities()), self.links())

    def questions(self) -> DataFrame:
        return self.raw("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))

    def conversations(self) -> DataFrame:
        """Every fifth conversation's user turns name a patient."""
        named = (F.col("conv_id") % 5 == 0) & (F.col("role") == "user")
        return self.raw("conversations").withColumn("text", F.when(named, F.concat("text", F.format_string(" about P-%04d", F.col("conv_id") * 4))).otherwise(F.col("text")))

    def replies(self) -> DataFrame:
        """A reply for each chunk with entities: JSON, every seventh garbage, every eleventh in a fence."""
        e = self.entities()
        names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "n", "name", "entity_type"))), lambda x: F.struct(x["name"].alias("name"), F.when(x["n"] == 2, "finding").otherwise(x["entity_type"]).alias("entity_type")))
        rows = e.groupBy("doc_id", "chunk_id", "order").agg(names.alias("entities"))
        first, last = F.element_at("entities", 1)["name"], F.element_at("entities", -1)["name"]
        relation = F.array(F.struct(first.alias("source"), last.alias("target"), F.lit(" ").alias("relation_type")))
        body = F.to_json(F.struct("entities", relation.alias("relations")))
        k = F.col("doc_id") + F.col("order")
        return rows.select("doc_id", "chunk_id", "order", F.when(k % 7 == 3, "no object here").when(k % 11 == 5, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("reply"))

    def registry(self) -> DataFrame:
        """A registry from pages: some entries break a rule."""
        k = F.col("page_id")
        pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (k % len(v) + 1).cast("int"))
        return self.raw("pages").select(
            F.concat(F.lit("source-"), (k - F.when(k % 50 == 49, 1).otherwise(0)).cast("string")).alias("name"),
            pick("vocabulary", "corpus", "patient-record").alias("category"),
            pick("green", "green", "amber", "red", "green").alias("license_class"),
            "url",
            F.when(k % 9 != 4, F.concat(F.lit("raw/"), k.cast("string"))).alias("dest"),
            pick(".html", ".xml", ".htm", ".pdf").alias("expected_extension"),
            F.when(k % 6 == 5, 1000000).otherwise(10).alias("min_bytes"),
            (k % 4 != 1).alias("fetchable"),
            F.when(k % 8 != 1, pick("Dead link (404)", "Cloudflare", "Registration", "host unreachable")).alias("skip_reason"),
            F.encode("html", "UTF-8").alias("content"),
            F.octet_length("html").cast("long").alias("total_bytes"),
            "page_id",
        )

    def ledger(self) -> DataFrame:
        return self.as_ledger(self.raw("events"))

    @staticmethod
    def as_ledger(events: DataFrame) -> DataFrame:
        kind = F.col("event_type")
        status = F.when(kind == "signup", "queued").when(kind.isin("view", "click"), "running").when(kind == "purchase", "succeeded").otherwise("failed")
        return events.select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), status.alias("status"))


# The same views for DuckDB. Each entry may use the ones before it.
_SPLIT = """
SELECT *, list_reduce(
    list_transform(
        list_filter(
            string_split(chr(10) || replace(regexp_replace(body, '([.!?])[ \\t\\r\\f\\v]+', '\\1' || chr(1) || ' ', 'g'), chr(10), chr(1) || chr(10)), chr(1)),
            lambda x: trim(x[2:], ' ' || chr(9) || chr(10) || chr(13)) <> ''),
        lambda x: {'blocks': [x[1]], 'cur': trim(x[2:], ' ' || chr(9) || chr(10) || chr(13))}),
    lambda a, x: CASE
        WHEN a.cur = '' THEN {'blocks': a.blocks, 'cur': x.cur}
        WHEN length(a.cur) + length(x.cur) + 1 > lim THEN {'blocks': list_append(a.blocks, a.cur), 'cur': x.cur}
        ELSE {'blocks': a.blocks, 'cur': a.cur || x.blocks[1] || x.cur} END,
    {'blocks': []::VARCHAR[], 'cur': ''}) AS r
FROM long_bodies
"""
CTES = {
    "src": f"""
SELECT doc_id, source || '/' || doc_id || '.txt' AS filename, CASE WHEN doc_id % 4 = 0 THEN 'patient_record' ELSE 'textbook' END AS doc_type,
    sha256(text) AS source_hash, make_timestamp(1704067200000000 + doc_id * 1000000) AS ingested_at,
    CASE WHEN doc_id % 4 = 0 THEN 'Name: Jane Doe' || chr(10) || '{HEAD}' || text || '{TAIL}' ELSE text END AS text, text AS own_text,
    CASE WHEN doc_id % 4 = 0 THEN 'P-' || CASE WHEN doc_id < 10000 THEN lpad(doc_id::VARCHAR, 4, '0') ELSE doc_id::VARCHAR END END AS pseudonym,
    CASE WHEN doc_id % 3 = 0 THEN doc_id % 2 = 0 WHEN doc_id % 3 = 1 THEN true END AS ingestion_complete, doc_id % 8 = 0 AS deidentified
FROM documents""".replace("\n:", ":"),
    "bodies": """
SELECT doc_id, doc_type, deidentified, 0 AS part, 1500 AS lim, trim(own_text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM src WHERE doc_type = 'textbook'
UNION ALL SELECT doc_id, doc_type, deidentified, 0, 1200, 'Subjective:' || chr(10) || trim(own_text, ' ' || chr(9) || chr(10) || chr(13)) FROM src WHERE doc_type = 'patient_record'
UNION ALL SELECT doc_id, doc_type, deidentified, 1, 1200, 'Plan:' || chr(10) || 'Rest and fluids.' FROM src WHERE doc_type = 'patient_record'""",
    "long_bodies": "SELECT * FROM bodies WHERE length(body) > lim",
    "reduced": _SPLIT,
    "blocks": """
SELECT doc_id, doc_type, deidentified, part, 0 AS k, body AS text FROM bodies WHERE length(body) <= lim AND body <> ''
UNION ALL SELECT doc_id, doc_type, deidentified, part, unnest(range(len(all_blocks))) AS k, unnest(all_blocks) AS text FROM (
    SELECT *, CASE WHEN r.cur <> '' THEN list_append(r.blocks, r.cur) ELSE r.blocks END AS all_blocks FROM reduced)""",
    "chunks": """
SELECT sha256(doc_id || chr(1) || (row_number() OVER w - 1)) AS chunk_id, doc_id, (row_number() OVER w - 1)::INT AS "order", text, doc_type AS source_type, deidentified
FROM blocks WINDOW w AS (PARTITION BY doc_id ORDER BY part, k)""",
    "item_tokens": "SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\\-]*') AS tokens, text FROM benchmark",
    "dictionary": """
SELECT term AS normalized_term, term, 'Definition of ' || term AS definition_text, 'bench' AS source, min(item_id) AS source_id,
    (['symptom', 'diagnosis', 'treatment'])[min(item_id) % 3 + 1] AS semantic_type
FROM (SELECT item_id, unnest(list_filter(tokens[1:8], lambda t: length(t) >= 5)) AS term FROM item_tokens
      UNION ALL SELECT item_id, tokens[1] || ' ' || tokens[2] FROM item_tokens WHERE len(tokens) >= 2) GROUP BY term""",
    "definitions": "SELECT * FROM dictionary WHERE source_id % 4 <> 3",
    "rules": """
SELECT DISTINCT t[1] AS source_term, t[2] AS target_term, CASE WHEN item_id % 2 = 0 THEN 'treats' ELSE 'causes' END AS relation_type
FROM (SELECT item_id, list_filter(tokens[1:8], lambda t: length(t) >= 5) AS t FROM item_tokens) WHERE len(t) >= 2 AND t[1] <> t[2]""",
    "chunk_tokens": """SELECT doc_id, chunk_id, "order", regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''\\-]*') AS tokens FROM chunks""",
    "runs": """
SELECT doc_id, chunk_id, "order", unnest(range(len(tokens)))::INT AS pos, 1 AS n, unnest(tokens) AS term FROM chunk_tokens
UNION ALL SELECT doc_id, chunk_id, "order", unnest(range(len(tokens) - 1))::INT, 2, unnest(list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1])) FROM chunk_tokens WHERE len(tokens) >= 2""",
    "entities": """
SELECT sha256(chunk_id || chr(1) || pos || chr(1) || n) AS entity_id, doc_id, chunk_id, "order", pos, n, r.term AS name, r.term AS normalized_name, semantic_type AS entity_type
FROM runs r JOIN dictionary d ON r.term = d.normalized_term""",
    "last_mention": "SELECT doc_id, chunk_id, normalized_name, arg_max(entity_id, pos * 10 + n) AS id FROM entities GROUP BY ALL",
    "relations": """
SELECT s.doc_id, s.chunk_id, s.id AS source_id, t.id AS target_id, source_term, target_term, relation_type
FROM rules JOIN last_mention s ON s.normalized_name = source_term JOIN last_mention t ON t.normalized_name = target_term AND t.chunk_id = s.chunk_id WHERE s.id <> t.id""",
    "links": "SELECT normalized_term AS normalized_name, min(normalized_term) OVER (PARTITION BY source_id) AS normalized_term, source FROM definitions",
    "defined_as": "SELECT e.entity_id, e.doc_id, e.chunk_id, e.normalized_name, l.normalized_term, l.source FROM entities e JOIN links l ON l.normalized_name = e.normalized_name",
    "open_chunks": "SELECT * FROM chunks WHERE source_type <> 'patient_record' OR deidentified",
    "mentions": "SELECT DISTINCT e.chunk_id, e.doc_id, e.\"order\", e.normalized_name AS name FROM entities e SEMI JOIN open_chunks c USING (chunk_id)",
    "edges": """
SELECT DISTINCT a.normalized_name AS a, b.normalized_name AS b FROM relations r
JOIN entities a ON a.entity_id = r.source_id JOIN entities b ON b.entity_id = r.target_id""",
    "both_edges": "SELECT a, b FROM edges UNION SELECT b, a FROM edges",
}


def with_ctes(*names: str) -> str:
    """``WITH`` clause of the named views and all before them that they use."""
    import re

    needed, todo = set(), list(names)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            todo += [other for other in CTES if re.search(rf"\b{other}\b", CTES[name]) and other != name]
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed) + "\n"
