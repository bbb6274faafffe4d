"""Entities and relations: plug-in extractors, replies, dictionary and rules, reuse, and linking to definitions."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TOKEN, normalize_term
from ..sources.scratch import stored
from ..sources.snapshots import Snapshots
from .filters import passing

#: Fixed values.
ENTITY_TYPES = ("symptom", "diagnosis", "treatment", "other")


def text_key(text: Column | str = "text") -> Column:
    return F.sha2(F.col(text) if isinstance(text, str) else text, 256)


REPLIES = "text_key string, reply string"


def ask(texts: DataFrame, fn: Callable[[str], str | None], concurrency: int) -> DataFrame:
    """texts(text_key, text) -> (text_key, reply): ``concurrency`` tasks call the extractor, once for each row."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"text_key": batch["text_key"], "reply": [fn(t) for t in batch["text"]]})

    return texts.select("text_key", "text").repartition(concurrency).mapInPandas(call, REPLIES)


def fill_replies(texts: DataFrame, fn: Callable[[str], str | None], concurrency: int, log: Snapshots, extractor: str, waves: int) -> DataFrame:
    """texts(text_key, text), distinct -> all their replies, from a store that outlives the run.

    What the store has is not asked again. The rest is asked in ``waves`` by hash, and each wave is kept as soon as it is
    there, so a run that is lost loses one wave at most. Failures (null) are not kept: the next run tries them again.
    """
    asked = []
    for wave in range(waves):
        mine = texts.filter(F.pmod(F.xxhash64("text_key"), F.lit(waves)) == wave)
        known = log.read(extractor, REPLIES).select("text_key")
        fresh = stored(ask(mine.join(known, "text_key", "left_anti"), fn, concurrency))
        if not fresh.isEmpty():
            log.commit({extractor: fresh.filter("reply IS NOT NULL")})
        asked.append(fresh.filter("reply IS NULL"))
    return functools.reduce(DataFrame.unionByName, asked, texts.join(log.read(extractor, REPLIES), "text_key").select("text_key", "reply"))


def extract_batch(chunks: DataFrame, fn: Callable[[str], str | None], concurrency: int, across_documents: bool = False, store: str | None = None, extractor: str = "replies", waves: int = 8) -> DataFrame:
    """Call the extractor once for each distinct text (of a document, or of all) and give every chunk its reply.

    A reply of null is a failure and is never reused: chunks that repeat a failed text are tried on their own, and are
    not marked reused. The result is a written table, so that reading it again calls nothing. With ``store``, a folder of
    snapshots, a text is asked once for all documents and its reply is kept under the name of the ``extractor``, for
    later runs too (``fill_replies``).
    """
    scope = [] if across_documents else ["doc_id"]
    keyed = chunks.withColumn("text_key", text_key())
    first = keyed.groupBy(*scope, "text_key").agg(F.min(F.struct("order", "chunk_id", "text")).alias("first")).select(*scope, "text_key", F.col("first.chunk_id").alias("asked_id"), F.col("first.text").alias("text"))
    if store is None:
        # a text of one document is asked apart from the same text of another
        by_scope = F.concat_ws("\u0001", *scope, "text_key")
        replies = stored(ask(first.withColumn("text_key", by_scope), fn, concurrency))
        asked = first.drop("text").withColumn("asked_key", by_scope)
    else:
        replies = stored(fill_replies(first.groupBy("text_key").agg(F.min("text").alias("text")), fn, concurrency, Snapshots(chunks.sparkSession, store), extractor, waves))
        asked = first.drop("text").withColumn("asked_key", F.col("text_key"))
    repeat = F.col("chunk_id") != F.col("asked_id")
    joined = keyed.join(asked, [*scope, "text_key"]).drop("text_key").join(replies.withColumnRenamed("text_key", "asked_key"), "asked_key")
    joined = joined.select("chunk_id", "doc_id", "order", "reply", (repeat & F.col("reply").isNotNull()).alias("reused"), F.when(repeat & F.col("reply").isNull(), F.col("text")).alias("again"))

    def retry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["again"].notna()
            batch.loc[own, "reply"] = [fn(t) for t in batch.loc[own, "again"]]
            yield batch.drop(columns="again")

    return stored(joined.mapInPandas(retry, joined.drop("again").schema))


def reuse_plan(chunks: DataFrame) -> DataFrame:
    """Which chunk of a document is extracted, and which chunks copy it: (doc_id, order, source_order, reused)."""
    w = Window.partitionBy("doc_id", text_key())
    source = F.min("order").over(w)
    return chunks.select("doc_id", "order", source.alias("source_order"), (F.col("order") != source).alias("reused"))


def reply_object(reply: Column | str = "reply") -> Column:
    """The JSON object in a reply, as text: the whole, or from the first brace to the last. Null where there is none."""
    raw = F.col(reply) if isinstance(reply, str) else reply
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    whole = F.try_parse_json(raw)
    value = F.when(whole.isNotNull(), whole).otherwise(F.try_parse_json(inner))
    text = F.when(whole.isNotNull(), raw).otherwise(inner)
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), text)


def parse_entities(replies: DataFrame) -> DataFrame:
    """replies(doc_id, chunk_id, reply) -> entities(entity_id, doc_id, chunk_id, pos, name, normalized_name,
    entity_type): items that are objects with a name; unknown types are ``other``; repeats stay."""
    items = F.from_json(F.get_json_object(reply_object(), "$.entities"), "array<string>")
    rows = replies.select("doc_id", "chunk_id", F.posexplode(items).alias("pos", "item")).filter(F.startswith(F.ltrim("item"), F.lit("{")))
    name = F.regexp_replace(F.get_json_object("item", "$.name"), r"(?U)^\s+|\s+$", "")
    kind = F.get_json_object("item", "$.entity_type")
    named = rows.withColumn("name", name).filter("name <> ''")
    return named.select(F.sha2(F.concat_ws("\u0001", "chunk_id", "pos"), 256).alias("entity_id"), "doc_id", "chunk_id", "pos", "name", normalize_term("name").alias("normalized_name"), F.when(kind.isin(*ENTITY_TYPES), kind).otherwise("other").alias("entity_type"))


def parse_relations(replies: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations of replies between entities of the same chunk (the last of a name), never of one with itself."""
    items = F.from_json(F.get_json_object(reply_object(), "$.relations"), "array<string>")
    rows = replies.select("chunk_id", F.posexplode(items).alias("pos", "item")).filter(F.startswith(F.ltrim("item"), F.lit("{")))
    end = lambda k: normalize_term(F.get_json_object("item", f"$.{k}"))
    kind = F.regexp_replace(F.get_json_object("item", "$.relation_type"), r"(?U)^\s+|\s+$", "")
    ends = rows.select("chunk_id", "pos", end("source").alias("source"), end("target").alias("target"), F.when(F.coalesce(kind, F.lit("")) != "", kind).otherwise("related_to").alias("relation_type"))
    last = entities.groupBy("chunk_id", "normalized_name").agg(F.max_by("entity_id", "pos").alias("id"))
    source = last.select("chunk_id", F.col("normalized_name").alias("source"), F.col("id").alias("source_id"))
    target = last.select("chunk_id", F.col("normalized_name").alias("target"), F.col("id").alias("target_id"))
    return ends.join(source, ["chunk_id", "source"]).join(target, ["chunk_id", "target"]).filter("source_id <> target_id").select("chunk_id", "pos", "source_id", "target_id", "relation_type")


def failed_chunks(replies: DataFrame) -> DataFrame:
    """Chunks whose reply holds no object."""
    return replies.filter(reply_object().isNull())


def term_trie(dictionary: DataFrame) -> DataFrame:
    """The first 1, 2 ... tokens of every term: (depth, prefix, deepest, whole, semantic_type). ``deepest`` is the length
    of the longest term below, and ``whole`` is true where the prefix is a term itself."""
    parts = F.split("normalized_name", " ")
    terms = dictionary.groupBy(F.col("normalized_term").alias("normalized_name")).agg(F.min("semantic_type").alias("semantic_type")).withColumn("n", F.size(parts))
    nodes = terms.select("n", "semantic_type", F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), " ").alias("prefix")))).alias("x")).select("n", "semantic_type", "x.*")
    here = F.col("n") == F.col("depth")
    return nodes.groupBy("depth", "prefix").agg(F.max("n").alias("deepest"), F.max(here).alias("whole"), F.max(F.when(here, F.col("semantic_type"))).alias("semantic_type"))


def dictionary_entities(chunks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Terms of the dictionary in each chunk: (doc_id, chunk_id, order, pos, n, name, normalized_name, entity_type).

    Places walk down a trie of the terms' tokens, one join a level (Spark broadcasts a level where it is small): all
    tokens meet the first level, and only what is still on a path goes on. The dictionary's own longest term ends the
    walk, so terms of any length are found.
    """
    trie = stored(term_trie(dictionary))
    depth = trie.agg(F.max("depth")).first()[0] or 1
    level = lambda d: trie.filter(F.col("depth") == d).select(F.col("prefix").alias(f"prefix_{d}"), F.col("deepest").alias(f"deepest_{d}"), F.col("whole").alias(f"whole_{d}"), F.col("semantic_type").alias(f"type_{d}"))
    tokens = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    every = chunks.select("doc_id", "chunk_id", "order", tokens.alias("tokens")).select("doc_id", "chunk_id", "order", "tokens", F.posexplode("tokens").alias("pos", "prefix_1"))
    walk = every.select("doc_id", "chunk_id", "order", "pos", "prefix_1", F.slice("tokens", F.col("pos") + 1, F.lit(depth)).alias("ahead")).join(level(1), "prefix_1")
    for d in range(2, depth + 1):
        on_path = (F.size("ahead") >= d) & (F.col(f"deepest_{d - 1}") >= d)
        # who has left the trie meets nothing, and not all in one place
        nowhere = F.concat(F.lit("\u0001"), "chunk_id")
        walk = walk.withColumn(f"prefix_{d}", F.when(on_path, F.array_join(F.slice("ahead", 1, d), " ")).otherwise(nowhere)).join(level(d), f"prefix_{d}", "left")
    hits = F.filter(F.array(*(F.when(F.col(f"whole_{d}"), F.struct(F.lit(d).alias("n"), F.col(f"prefix_{d}").alias("name"), F.col(f"type_{d}").alias("semantic_type"))) for d in range(1, depth + 1))), lambda h: h.isNotNull())
    found = walk.select("doc_id", "chunk_id", "order", "pos", F.explode(hits).alias("h")).select("doc_id", "chunk_id", "order", "pos", "h.*")
    kind = F.when(F.col("semantic_type").isin(*ENTITY_TYPES), F.col("semantic_type")).otherwise("other")
    return found.select(F.sha2(F.concat_ws("\u0001", "chunk_id", "pos", "n"), 256).alias("entity_id"), "doc_id", "chunk_id", "order", "pos", "n", "name", F.col("name").alias("normalized_name"), kind.alias("entity_type"))


def rule_relations(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """A rule (source_term, target_term, relation_type) fires once in each chunk that mentions both, between the last
    mentions. Names are reduced to one row per chunk before they meet, so repeats make no pairs."""
    # which chunks hold both terms of a rule is settled by names and short hashes, and only their mentions come with ids
    able = passing(entities, "normalized_name", rules.select(F.explode(F.array("source_term", "target_term")))).withColumn("h", F.xxhash64("chunk_id"))
    named = able.select("h", "normalized_name").distinct()
    fired = named.join(rules.withColumnRenamed("source_term", "normalized_name"), "normalized_name").select("h", F.col("target_term").alias("normalized_name")).join(named, ["h", "normalized_name"], "left_semi").select("h")
    both = passing(able, "h", fired)
    last = both.groupBy("doc_id", "chunk_id", "normalized_name").agg(F.max_by("entity_id", F.struct("pos", "n")).alias("id"))
    source = last.select("doc_id", "chunk_id", F.col("normalized_name").alias("source_term"), F.col("id").alias("source_id"))
    target = last.select("chunk_id", F.col("normalized_name").alias("target_term"), F.col("id").alias("target_id"))
    return source.join(rules, "source_term").join(target, ["chunk_id", "target_term"]).filter("source_id <> target_id").select("doc_id", "chunk_id", "source_id", "target_id", "source_term", "target_term", "relation_type")


def link_definitions(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entities with their definition on the normalised name; those without stay, with nulls. A term that several
    sources define gives the definition of the first source by name, so no mention is doubled."""
    one = dictionary.groupBy(F.col("normalized_term").alias("normalized_name")).agg(F.min_by(F.struct("term", "definition_text", "source", "source_id"), F.struct("source", "source_id")).alias("d"))
    return entities.join(one.select("normalized_name", "d.*"), "normalized_name", "left")


def defined_as(entities: DataFrame, links: DataFrame) -> DataFrame:
    """DEFINED_AS edges: (entity_id, doc_id, chunk_id, normalized_name, normalized_term, source), one from each mention to
    each definition that its name is linked to.

    links(normalized_name, normalized_term, source) is what a linker says: a definition may stand under another name
    than the mention's (a preferred term). Nulls link nothing; repeated links make one edge.
    """
    once = links.select("normalized_name", "normalized_term", "source").filter("normalized_term IS NOT NULL").distinct()
    return entities.select("entity_id", "doc_id", "chunk_id", "normalized_name").join(once, "normalized_name").select("entity_id", "doc_id", "chunk_id", "normalized_name", "normalized_term", "source")


def undefined_entities(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """How often each name without a definition is mentioned."""
    counts = entities.groupBy("normalized_name").agg(F.count("*").alias("mentions"))
    return counts.join(dictionary.select(F.col("normalized_term").alias("normalized_name")), "normalized_name", "left_anti")


def load_definitions(entries: DataFrame) -> DataFrame:
    """entries(seq, term, definition_text, source, source_id, semantic_type) keyed by normalised term; later wins."""
    keyed = entries.withColumn("normalized_term", normalize_term("term"))
    last = keyed.groupBy("normalized_term").agg(F.max_by(F.struct("term", "definition_text", "source", "source_id", "semantic_type"), "seq").alias("d"))
    return last.select("normalized_term", "d.*")


def merge_definitions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Definitions unique by (normalized_term, source); of equals the largest ``seq`` stays."""
    both = old.unionByName(new)
    last = both.groupBy("normalized_term", "source").agg(F.max_by(F.struct("term", "definition_text", "source_id", "semantic_type", "seq"), "seq").alias("d"))
    return last.select("normalized_term", "source", "d.*")


def merge_relations(relations: DataFrame) -> DataFrame:
    """Edges unique by (source, target, type)."""
    return relations.select("source_id", "target_id", "relation_type").distinct()
