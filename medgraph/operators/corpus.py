"""Audit of a registry of source files: validation, verification, skips, manifest and report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sniff

#: Fixed values.
CATEGORIES = ("vocabulary", "corpus", "patient-record")
LICENSES = ("green", "amber", "red")
REPORTED = ("SKIP-GATED", "SKIP-BLOCKED", "SKIP-DEAD", "FAIL-HTML", "FAIL-SIZE", "FAIL-TYPE", "FAIL")
HEADINGS = (
    "## Registration required",
    "## Confirmed Cloudflare-blocked / unreachable",
    "## Confirmed dead / 404",
    "## Failed content verification this run (soft-404 detected)",
    "## Failed content verification this run (undersized)",
    "## Failed content verification this run (unexpected type)",
    "## Other fetch failures",
)
NOTHING = "Nothing to report — every registry entry either fetched OK or hasn't run yet."
MANIFEST = ("status", "bytes", "sha256_12", "path", "url", "category", "license_class", "name", "fetched_at", "http_status", "content_type", "notes")


def filter_registry(registry: DataFrame, category: str | None = None, license_class: str | None = None, names: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Entries by category, license class and name; ``limit`` of them by name, if asked."""
    for column, value in (("category", category), ("license_class", license_class)):
        if value:
            registry = registry.filter(F.col(column) == value)
    if names:
        registry = registry.filter(F.col("name").isin(names))
    return registry.orderBy("name").limit(limit) if limit else registry


def registry_violations(registry: DataFrame) -> DataFrame:
    """(name, violation): repeated names, fetchable entries without a place, others without a reason, unknown classes."""
    found = {
        "fetchable without dest": F.col("fetchable") & (F.coalesce("dest", F.lit("")) == ""),
        "not fetchable without reason": ~F.col("fetchable") & (F.coalesce("skip_reason", F.lit("")) == ""),
        "unknown category": ~F.coalesce(F.col("category").isin(*CATEGORIES), F.lit(False)),
        "unknown license class": ~F.coalesce(F.col("license_class").isin(*LICENSES), F.lit(False)),
    }
    marks = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in found.items()]), lambda x: x.isNotNull())
    rows = registry.select("name", F.explode(marks).alias("violation"))
    repeated = registry.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name", F.lit("duplicate name").alias("violation"))
    return rows.unionByName(repeated)


def verification(content: str = "content", total: str = "total_bytes", extension: str = "expected_extension", least: str = "min_bytes") -> Column:
    """FAIL-SIZE below the floor, FAIL-HTML for a page where none is expected, else OK."""
    page = (sniff(content) == "html") & ~F.coalesce(F.col(extension).isin(".html", ".htm"), F.lit(False))
    return F.when(F.col(total) < F.col(least), "FAIL-SIZE").when(page, "FAIL-HTML").otherwise("OK")


def skip_status(reason: str = "skip_reason") -> Column:
    """Why an entry isn't fetched."""
    r = F.lower(F.coalesce(F.col(reason), F.lit("")))
    has = lambda *words: F.rlike(r, F.lit("|".join(words)))
    return F.when(has("dead", "404"), "SKIP-DEAD").when(has("cloudflare", "blocked", "unreachable"), "SKIP-BLOCKED").otherwise("SKIP-GATED")


def manifest_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Manifest rows by name, the last one (by ``seq``) of each; tabs and line ends in values become blanks."""
    columns = [c for c in old.columns if c not in ("name", "seq")]
    flat = [F.regexp_replace(c, "[\t\n]", " ").alias(c) if t == "string" else F.col(c) for c, t in old.dtypes if c in columns]
    last = old.unionByName(new).select("name", "seq", *flat).groupBy("name").agg(F.max_by(F.struct(*columns), "seq").alias("r"))
    return last.select("name", "r.*")


def verified_sources(registry: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries that need no new fetch: OK in the manifest, with a file (path, sha256) of the recorded hash."""
    ok = manifest.filter("status = 'OK'").select("name", "sha256_12")
    there = files.select(F.col("path").alias("dest"), F.substring("sha256", 1, 12).alias("sha256_12"))
    return registry.filter("dest IS NOT NULL").join(ok, "name").join(there, ["dest", "sha256_12"], "left_semi").select("name", "dest")


def skip_report(manifest: DataFrame) -> DataFrame:
    """(rank, status, name, category, license_class, url, notes) of what was not fetched, by group; rows in any order,
    ``rank`` orders groups."""
    rank = F.array_position(F.array(*[F.lit(s) for s in REPORTED]), F.col("status"))
    return manifest.withColumn("rank", rank).filter("rank > 0").select(F.col("rank").cast("int"), "status", "name", "category", "license_class", "url", "notes")


def report_lines(manifest: DataFrame) -> DataFrame:
    """The report as (rank, name, line), to be read in that order: a heading (empty name) for each group that has entries,
    a line for each entry with its notes below it, "nothing" in place of the groups where there are none, and last the
    number of sources that are there."""
    rows = skip_report(manifest)
    told = F.coalesce(F.concat(F.lit("\n  "), F.when(F.col("notes") != "", F.col("notes"))), F.lit(""))
    shown = lambda c: F.coalesce(F.col(c), F.lit(""))
    line = F.concat(F.lit("- **"), shown("name"), F.lit("** (`"), shown("category"), F.lit("`/`"), shown("license_class"), F.lit("`) — "), shown("url"), told)
    heads = rows.select("rank").distinct().select("rank", F.lit("").alias("name"), F.get(F.array(*[F.lit(h) for h in HEADINGS]), F.col("rank") - 1).alias("line"))
    # one row each, also for an empty manifest
    sums = manifest.agg(F.count_if(F.col("status") == "OK").alias("ok"), F.count_if(F.col("status").isin(*REPORTED)).alias("bad"))
    fetched = sums.select(F.lit(len(HEADINGS) + 1).alias("rank"), F.lit("").alias("name"), F.concat(F.col("ok").cast("string"), F.lit(" source(s) successfully fetched and verified.")).alias("line"))
    nothing = sums.filter("bad = 0").select(F.lit(0).alias("rank"), F.lit("").alias("name"), F.lit(NOTHING).alias("line"))
    return rows.select("rank", "name", line.alias("line")).unionByName(heads).unionByName(fetched).unionByName(nothing)


def license_gate(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Only what comes from green sources."""
    return rows.join(registry.filter("license_class = 'green'").select("name").distinct(), "name", "left_semi")
