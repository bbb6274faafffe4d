"""Continuous intake: uploads arrive as files, and the batch jobs run on each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunk import chunk_documents
from ..operators.extract import dictionary_entities, merge_relations, rule_relations
from ..sources import files
from ..sources.scratch import stored
from ..sources.snapshots import Snapshots


def read_uploads(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


#: Tables of the store that a stream fills.
DOCUMENTS = "doc_id long, source_hash string, doc_type string"
RULES = "source_term string, target_term string, relation_type string"
DICTIONARY = "normalized_term string, semantic_type string"


def with_texts(uploads: DataFrame) -> DataFrame:
    """uploads(doc_id, filename, content, doc_type, ingested_at) as texts with their hash. Files of an unknown kind, and
    those that can't be read, are left out."""
    known = uploads.withColumn("reader", files.reader_of("filename")).filter("reader IS NOT NULL")
    texts = files.read_texts(known.select("doc_id", "reader", "content")).filter("error IS NULL").select("doc_id", "text")
    return known.select("doc_id", "doc_type", "ingested_at", F.sha2("content", 256).alias("source_hash")).join(texts, "doc_id")


def stream_ingest(uploads: DataFrame, store: str, checkpoint: str, dictionary: DataFrame | None = None, rules: DataFrame | None = None, source: str = "uploads") -> StreamingQuery:
    """Documents, chunks, entities and edges of every new upload of a stream, in a store of snapshots.

    Uploads bring a text, or a file's name and content. Of equal content and type the earliest is taken, unless the store
    has it already (only the two key columns of the store are read). A micro-batch becomes visible with all four tables
    at once, under the stream's name and its number; one that is tried again after a failure, whenever that came, is
    there once.
    """

    def ingest(batch: DataFrame, number: int) -> None:
        spark, key = batch.sparkSession, ["source_hash", "doc_type"]
        log = Snapshots(spark, store)
        texts = batch if "text" in batch.columns else with_texts(batch)
        first = texts.groupBy(*key).agg(F.min_by(F.struct("doc_id", "text"), F.struct("ingested_at", "doc_id")).alias("d")).select(*key, "d.*")
        first = stored(first.join(log.read("documents", DOCUMENTS).select(*key), key, "left_anti"))
        chunks = stored(chunk_documents(first))
        terms = dictionary if dictionary is not None else spark.createDataFrame([], DICTIONARY)
        entities = stored(dictionary_entities(chunks, terms))
        edges = merge_relations(rule_relations(entities, rules if rules is not None else spark.createDataFrame([], RULES)))
        log.commit({"documents": first.select("doc_id", *key), "chunks": chunks, "entities": entities, "edges": edges}, source, number)

    return uploads.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drop_duplicates(uploads: DataFrame, delay: str = "1 day") -> DataFrame:
    """A stream without repeats of (source_hash, doc_type) within the watermark, which bounds the state."""
    return uploads.withWatermark("ingested_at", delay).dropDuplicatesWithinWatermark(["source_hash", "doc_type"])


def progress(events: DataFrame, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Events(ts, status) counted by window and status; rows later than the watermark are dropped. Streams and tables."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "status", "n")
