"""Small helpers that the operators of this folder share: scratch tables and size figures."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's switch to remove a query's shuffle files when it ends, and not once the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Set only where the session names no shared folder, as in tests on one machine.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a folder of our own on
    one machine; on a cluster, whose machines would each write to their own disk, an error."""
    set_in_session = spark.conf.get("spark.checkpoint.dir", None)
    if set_in_session:
        return set_in_session.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="medgraph-shared-"))
    return "file://" + _OWN[0]


def saved(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` as a Parquet table in the shared folder and read it back.

    A lost executor costs nothing of it, and readers prune its columns. ``codec`` is for tables that mostly
    hold text. The shuffle files behind the table go as soon as it is written: nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names after ``names`` that ``df`` does not have, whatever the case of its own."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def clean_docs(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (string, as it is), and no other column, whatever else the table has."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *columns)


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one pass, one number. Sets how many shards an operator deals its work to."""
    row = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()
    return int(row["n"] or 0)


def numbered(df: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``df`` with a column ``name`` of 0, 1, 2 ... in the order of ``columns``, without a sort in one task.

    Rows are range-sorted and written once; each partition's count gives the next one's first number. Only those
    counts, one for each partition, reach the driver.
    """
    placed = saved(df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33).cast("int")
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    first, starts = 0, []
    for p, n in counts:
        starts.append((p, first))
        first += n
    table = df.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _first long")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(table), "_part").withColumn(name, F.col("_first") + local).drop("_part", "_first", "_at")
