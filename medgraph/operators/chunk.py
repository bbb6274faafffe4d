"""Documents to chunks: paragraphs grouped up to a size, patient records by section."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXTBOOK_CHARS, PATIENT_CHARS = 1500, 1200
#: Lines that head a section of a clinical note.
HEADERS = (
    "subjective", "objective", "assessment", "plan", "chief complaint", "history of present illness", "hpi",
    "past medical history", "pmh", "medications", "allergies", "review of systems", "ros",
    "physical exam(?:ination)?", "labs?", "impression", "diagnosis", "treatment plan",
)
HEADER = re.compile(rf"^\s*(?:{'|'.join(HEADERS)})\s*:?\s*$", re.IGNORECASE | re.MULTILINE)
_GAP, _SENTENCE = re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+")


def split_paragraphs(text: str) -> list[str]:
    return [p for p in map(str.strip, _GAP.split(text)) if p]


def split_long(paragraph: str, limit: int) -> list[str]:
    """Lines and sentences refilled up to ``limit``; a longer sentence stays whole. One list of parts a block, so
    time is in proportion to the text."""
    blocks, parts, size = [], [], 0
    for line in paragraph.split("\n"):
        for k, sentence in enumerate(_SENTENCE.split(line)):
            piece = sentence.strip()
            if not piece:
                continue
            if parts and size + len(piece) + 1 > limit:
                blocks.append("".join(parts))
                parts, size = [], 0
            if parts:
                parts.append(" " if k else "\n")
                size += 1
            parts.append(piece)
            size += len(piece)
    return [*blocks, "".join(parts)] if parts else blocks


def group(paragraphs: list[str], limit: int) -> list[str]:
    """Neighbouring paragraphs up to ``limit`` characters, blank lines between them not counted."""
    blocks, held, size = [], [], 0
    for p in [*paragraphs, None]:
        too_long = p is not None and len(p) > limit
        if held and (p is None or too_long or size + len(p) > limit):
            blocks.append("\n\n".join(held))
            held, size = [], 0
        if too_long:
            blocks += split_long(p, limit)
        elif p is not None:
            held.append(p)
            size += len(p)
    return blocks


def textbook(text: str, limit: int = TEXTBOOK_CHARS) -> list[str]:
    return group(split_paragraphs(text), limit)


def patient(text: str, limit: int = PATIENT_CHARS) -> list[str]:
    """A block or more per section. With two sections or more, what stands before the first header is dropped; with
    fewer, paragraphs are grouped as in textbooks."""
    starts = [m.start() for m in HEADER.finditer(text)]
    sections = [s for s in (text[a:b].strip() for a, b in zip(starts, [*starts[1:], len(text)][: len(starts)], strict=True)) if s]
    if len(sections) < 2:
        return group(split_paragraphs(text), limit)
    return [block for s in sections for block in group([s], limit)]


def _udf(fn) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: fn(t or ""))

    return run


def chunk_texts(text: Column, doc_type: Column, textbook_chars: int = TEXTBOOK_CHARS, patient_chars: int = PATIENT_CHARS) -> Column:
    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([patient(t or "", patient_chars) if k == "patient_record" else textbook(t or "", textbook_chars) for t, k in zip(texts, kinds, strict=True)], index=texts.index)

    return run(text, doc_type)


def group_paragraphs(text: Column, limit: int) -> Column:
    return _udf(lambda t: group(split_paragraphs(t), limit))(text)


def split_long_paragraphs(text: Column, limit: int) -> Column:
    return _udf(lambda t: split_long(t, limit))(text)


def chunk_id(doc_id: Column | str = "doc_id", order: Column | str = "order") -> Column:
    """The same id for the same document and place, however often a task runs."""
    return F.sha2(F.concat_ws("\u0001", F.col(doc_id) if isinstance(doc_id, str) else doc_id, F.col(order) if isinstance(order, str) else order), 256)


def chunk_documents(docs: DataFrame, textbook_chars: int = TEXTBOOK_CHARS, patient_chars: int = PATIENT_CHARS) -> DataFrame:
    """docs(doc_id, doc_type, text, ...) -> chunks(chunk_id, doc_id, order, text, source_type, deidentified).

    ``deidentified`` comes from the input where it has the column. One map over documents, no shuffle.
    """
    clean = F.col("deidentified") if "deidentified" in docs.columns else F.lit(None).cast("boolean")
    rows = docs.select("doc_id", F.col("doc_type").alias("source_type"), clean.alias("deidentified"), F.posexplode(chunk_texts(F.col("text"), F.col("doc_type"), textbook_chars, patient_chars)).alias("order", "text"))
    return rows.select(chunk_id().alias("chunk_id"), "doc_id", "order", "text", "source_type", "deidentified")
