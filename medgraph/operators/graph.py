"""Graph tables: statistics, dumps, listings, duplicates, resumed runs, deletes and upserts."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import stored


def _count(df: DataFrame, key: str, name: str, value: Column | None = None) -> DataFrame:
    return df.groupBy(key).agg((F.count("*") if value is None else value).alias(name))


def _with_counts(base: DataFrame, key: str, parts: list[DataFrame]) -> DataFrame:
    """Left joins of small aggregates on one key, absent ones as 0."""
    for part in parts:
        name = next(c for c in part.columns if c != key)
        base = base.join(part, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return base


def ingest_stats(docs: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Counts per document: chunks, entities, relations as listed and as stored (unique), definitions matched, missing.

    Every table is reduced to a row per document before it is joined.
    """
    names = definitions.select(F.col("normalized_term").alias("normalized_name")).distinct()
    matched = _count(entities.join(names, "normalized_name", "left_semi"), "doc_id", "definitions_matched")
    unique = relations.select("doc_id", "source_id", "target_id", "relation_type").distinct()
    parts = [_count(chunks, "doc_id", "chunk_count"), _count(entities, "doc_id", "entity_count"), _count(relations, "doc_id", "relation_count"), _count(unique, "doc_id", "stored_relations"), matched]
    rows = _with_counts(docs.select("doc_id"), "doc_id", parts)
    return rows.withColumn("definitions_missing", F.col("entity_count") - F.col("definitions_matched"))


def chunk_stats(chunks: DataFrame, entities: DataFrame, relations: DataFrame, definitions: DataFrame) -> DataFrame:
    """Per chunk: entities, outgoing stored relations, distinct entities that have a definition."""
    names = definitions.select(F.col("normalized_term").alias("normalized_name")).distinct()
    defined = _count(entities.join(names, "normalized_name", "left_semi"), "chunk_id", "defined", F.countDistinct("entity_id"))
    out = relations.select("source_id", "target_id", "relation_type").distinct().join(entities.select(F.col("entity_id").alias("source_id"), "chunk_id"), "source_id")
    return _with_counts(chunks.select("chunk_id", "doc_id", "order"), "chunk_id", [_count(entities, "chunk_id", "entities"), _count(out, "chunk_id", "relations"), defined])


def stats_or_recount(docs: DataFrame, recounted: DataFrame, columns: list[str]) -> DataFrame:
    """Stored statistics where a document has them, else recounted ones."""
    again = recounted.select("doc_id", *[F.col(c).alias(f"_{c}") for c in columns])
    return docs.join(again, "doc_id", "left").select("doc_id", *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def document_graph(docs: DataFrame, chunks: DataFrame, entities: DataFrame, definitions: DataFrame) -> DataFrame:
    """Flat dump: a row for each entity of each chunk, with its definition; chunks without entities have one row."""
    found = entities.select("chunk_id", "entity_id", "name", "entity_type", "normalized_name").join(definitions.select(F.col("normalized_term").alias("normalized_name"), "definition_text"), "normalized_name", "left")
    return docs.select("doc_id", "filename", "doc_type").join(chunks.select("doc_id", "chunk_id", "order", "text"), "doc_id").join(found, "chunk_id", "left")


def document_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """The dump's stored relations: (doc_id, source_name, relation_type, target_name), each edge of the document once."""
    name = lambda side: entities.select(F.col("entity_id").alias(f"{side}_id"), F.col("name").alias(f"{side}_name"))
    edges = relations.select("doc_id", "source_id", "target_id", "relation_type").distinct()
    return edges.join(name("source"), "source_id").join(name("target"), "target_id").select("doc_id", "source_name", "relation_type", "target_name")


def nested_graph(flat: DataFrame, relations: DataFrame) -> DataFrame:
    """The dump of chosen documents as one row each: chunks in order with their entities, and the relations of
    ``document_relations`` in order of their names (an empty array where there are none). One document is one row, so
    this is for documents that a caller can hold; the flat dump has no such bound."""
    entity = F.when(F.col("entity_id").isNotNull(), F.struct("name", "entity_type", "definition_text"))
    chunks = flat.groupBy("doc_id", "filename", "doc_type", "order", "chunk_id", "text").agg(F.array_sort(F.collect_list(entity)).alias("entities"))
    nested = chunks.groupBy("doc_id", "filename", "doc_type").agg(F.array_sort(F.collect_list(F.struct("order", "chunk_id", "text", "entities"))).alias("chunks"))
    edge = F.struct("source_name", "relation_type", "target_name")
    listed = relations.groupBy("doc_id").agg(F.array_sort(F.collect_list(edge)).alias("relations"))
    rows = nested.join(listed, "doc_id", "left")
    return rows.withColumn("relations", F.coalesce("relations", F.array().cast(listed.schema["relations"].dataType)))


def recent_documents(docs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest documents with their status: the limit is the feature."""
    return docs.orderBy(F.desc("ingested_at"), F.desc("doc_id")).limit(limit).select("doc_id", "filename", "doc_type", "ingested_at", document_status())


def document_status() -> Column:
    """Only a flag that is false means incomplete; older documents without one are done."""
    return F.when(~F.col("ingestion_complete"), "incomplete").otherwise("complete").alias("status")


def place_in_group(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """The number of each row within its group, from 1, in the given order (which should leave no ties).

    A range sort over keys and order cuts hot groups at partition ends; rows are numbered within (partition, group), and
    what earlier partitions hold of the group is added. Per group the offsets see one row a partition. The sorted table
    is written first, since its parts are read twice and must stay the same.
    """
    cut = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()))
    held = cut.groupBy("_part", *keys).agg(F.count("*").alias("_held"))
    offsets = held.withColumn("_before", F.coalesce(F.sum("_held").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).filter("_before > 0")
    inside = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    same = [inside[k].eqNullSafe(offsets[k]) for k in ("_part", *keys)]
    on = functools.reduce(lambda a, b: a & b, same)
    return inside.join(offsets, on, "left").select(*[inside[c] for c in df.columns], (F.col("_at") + F.coalesce("_before", F.lit(0))).cast("int").alias(name))


def documents_by_hash(docs: DataFrame) -> DataFrame:
    """Place of each document among those of the same content and type, oldest first."""
    rows = docs.select("doc_id", "source_hash", "doc_type", "ingested_at")
    return place_in_group(rows, ["source_hash", "doc_type"], ["ingested_at", "doc_id"]).drop("ingested_at")


def duplicate_actions(docs: DataFrame) -> DataFrame:
    """What happens to each copy: the first complete one is kept and incomplete ones go; without a complete one the
    latest incomplete is resumed and the others go; further complete copies are left alone.

    Groups are summed up first (copies of one content may be a third of all documents) and joined back by their key.
    """
    key = ["source_hash", "doc_type"]
    incomplete = ~F.coalesce("ingestion_complete", F.lit(True))
    at = F.struct("ingested_at", "doc_id")
    groups = docs.groupBy(*key).agg(F.min(F.when(~incomplete, at)).alias("done"), F.max(F.when(incomplete, at)).alias("last"))
    rows = docs.select("doc_id", *key, at.alias("at"), incomplete.alias("incomplete")).join(groups, key)
    action = (
        F.when(F.col("done").isNotNull() & F.col("incomplete"), "delete")
        .when(F.col("done").isNotNull(), F.when(F.col("at") == F.col("done"), "keep").otherwise("leave"))
        .otherwise(F.when(F.col("at") == F.col("last"), "resume").otherwise("delete"))
    )
    return rows.select("doc_id", action.alias("action"))


def new_documents(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Uploads whose content is not stored complete under the same type."""
    done = store.filter(F.coalesce("ingestion_complete", F.lit(True))).select("source_hash", "doc_type").distinct()
    return batch.join(done, ["source_hash", "doc_type"], "left_anti")


def finished_chunks(old: DataFrame) -> DataFrame:
    """Old chunks that were fully written: flagged so, or (in documents without any flag) all but the last."""
    per = old.groupBy("doc_id").agg(F.max(F.col("extracted").isNotNull()).alias("flagged"), F.max("order").alias("last"))
    return old.join(per, "doc_id").filter(F.when(F.col("flagged"), F.coalesce("extracted", F.lit(False))).otherwise(F.col("order") < F.col("last"))).select(*old.columns)


def resume_plan(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, order, action): reuse a finished chunk whose text is the same, delete other old ones, do the rest."""
    done = finished_chunks(old).select("doc_id", "order", F.col("text").alias("done_text"))
    had = old.select("doc_id", "order", F.lit(True).alias("had"))
    now = new.select("doc_id", "order", "text")
    rows = now.join(had.join(done, ["doc_id", "order"], "left"), ["doc_id", "order"], "full_outer")
    same = F.coalesce(F.col("done_text") == F.col("text"), F.lit(False))
    both = F.when(same, F.array(F.lit("reuse"))).otherwise(F.filter(F.array(F.when(F.col("had"), F.lit("delete")), F.when(F.col("text").isNotNull(), F.lit("todo"))), lambda x: x.isNotNull()))
    return rows.select("doc_id", "order", F.explode(both).alias("action"))


def delete_documents(gone: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the rows of some documents (``doc_id``); definitions have none and stay."""
    return {name: t.join(gone.select("doc_id").distinct(), "doc_id", "left_anti") for name, t in tables.items()}


def delete_chunks(gone: DataFrame, chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chunks, entities and edges without some chunks (``chunk_id``)."""
    ids = gone.select("chunk_id").distinct()
    dead = entities.join(ids, "chunk_id", "left_semi").select("entity_id")
    edges = relations.join(dead.withColumnRenamed("entity_id", "source_id"), "source_id", "left_anti").join(dead.withColumnRenamed("entity_id", "target_id"), "target_id", "left_anti")
    return chunks.join(ids, "chunk_id", "left_anti"), entities.join(ids, "chunk_id", "left_anti"), edges


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``new`` rows replace old ones of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def write_table(df: DataFrame, path: str, partition: str) -> None:
    """Rewrite only the partitions that ``df`` holds; running it again gives the same table."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def run_ledger(events: DataFrame, hours: int = 24) -> DataFrame:
    """events(job, ts, status) -> the latest state of each job that is active, or finished within ``hours``."""
    latest = events.groupBy("job").agg(F.max_by("status", F.struct("ts", "seq")).alias("status"), F.max("ts").alias("updated_at"), F.min("ts").alias("created_at"))
    now = events.agg(F.max("ts").alias("now"))
    recent = F.col("status").isin("queued", "running") | (F.col("updated_at") >= F.col("now") - F.expr(f"INTERVAL {hours} HOURS"))
    return latest.crossJoin(F.broadcast(now)).filter(recent).select("job", "status", "created_at", "updated_at")
