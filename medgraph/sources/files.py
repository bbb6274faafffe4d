"""Files as tables: intake with hashes, routing by suffix, and the manifest's TSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import decode, html_to_text, markdown_to_text
from ..operators.corpus import MANIFEST
from . import records

#: Suffixes by the reader that takes them.
READERS = {
    "text": (".txt", ".text"),
    "html": (".html", ".htm", ".xhtml"),
    "xml": (".xml",),
    "json": (".json",),
    "jsonl": (".jsonl", ".ndjson"),
    "markdown": (".md", ".markdown"),
    "csv": (".csv",),
    "tsv": (".tsv",),
}


def _suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(name, r"([^/]*)$", 1), r"(\.[^.]*)$", 1))


def reader_of(name: Column | str) -> Column:
    """The reader that takes a file, by its suffix; null where none does."""
    suffix, reader = _suffix(F.col(name) if isinstance(name, str) else name), F.lit(None).cast("string")
    for kind, suffixes in READERS.items():
        reader = F.when(suffix.isin(*suffixes), kind).otherwise(reader)
    return reader


def intake(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files(path, content) -> (accepted with filename, suffix, reader, source_hash; rejects with unknown suffix)."""
    path = F.col("path")
    rows = files.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("filename"), _suffix(path).alias("suffix"), reader_of(path).alias("reader"), F.sha2("content", 256).alias("source_hash"), "content")
    return rows.filter("reader IS NOT NULL"), rows.filter("reader IS NULL").drop("content", "reader")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def read_texts(accepted: DataFrame) -> DataFrame:
    """Texts of accepted files (doc_id, reader, content) as (doc_id, text, error): built-in readers for text, HTML and
    Markdown, and one pass of helpers, chosen by the reader, for the record formats. A record file without a paragraph
    gives no row. Files too large for one row are for ``records.xml_records`` and ``records.jsonl_records``."""
    plain = accepted.filter("reader IN ('text', 'html', 'markdown')").withColumn("raw", decode("content"))
    text = F.when(F.col("reader") == "html", html_to_text("raw")).when(F.col("reader") == "markdown", markdown_to_text("raw")).otherwise(F.col("raw"))
    is_xml = F.col("reader") == "xml"  # its parser reads bytes, since a file may declare its own encoding
    formats = accepted.filter("reader NOT IN ('text', 'html', 'markdown')").select("doc_id", "reader", F.when(is_xml, F.col("content")).alias("raw"), F.when(~is_xml, decode("content")).alias("body"))
    return plain.select("doc_id", text.alias("text"), F.lit(None).cast("string").alias("error")).unionByName(records.record_texts(formats))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page_number, text) -> (doc_id, text): a document's pages in order with an empty line between."""
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n\n").alias("text"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Entries for ``extract.load_definitions`` from JSON files ``{"terms": [{"term", "definition_text", "source",
    "source_id", "semantic_type"}, ...]}``, one object a file: ``seq`` orders them by file and place. Entries without a
    source are ``stub``, entries without a term give no row, and a file without the list gives none."""
    entry = "term string, definition_text string, source string, source_id string, semantic_type string"
    read = spark.read.schema(f"terms array<struct<{entry.replace(' string', ': string')}>>").option("multiLine", True).option("recursiveFileLookup", True).json(path)
    rows = read.select(F.col("_metadata.file_path").alias("file"), "terms").select("file", F.posexplode("terms").alias("pos", "e"))
    return rows.filter("e.term IS NOT NULL").select(F.struct("file", "pos").alias("seq"), "e.term", "e.definition_text", F.coalesce("e.source", F.lit("stub")).alias("source"), "e.source_id", "e.semantic_type")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"{c} {'long' if c == 'bytes' else 'string'}" for c in MANIFEST)
    return spark.read.csv(path, sep="\t", header=True, schema=schema, quote="")


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.select(*MANIFEST).write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")
