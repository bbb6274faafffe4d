"""Tables that change together.

A version of the store is one small file that names the Parquet folders of every table. Data is written first, under
names of its own; then the version file appears by one rename that never replaces another. Readers take the newest
version, so they see all tables of a change or none of them. A change may carry a source and a number (of a micro-batch,
or of a wave of a long job): one that is there already is not made twice.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer changed the store while a replacement of its tables was made from an older version."""


class Version(NamedTuple):
    number: int
    #: folders and schema of each table
    tables: dict[str, dict]
    #: the last number of each source
    batches: dict[str, int]


class Snapshots:
    """A store under ``root``, a folder that driver and executors share, on any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path(self.root).getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(self._files.getUri(), conf)

    def _path(self, name: str):
        return self._fs.Path(name)

    def versions(self) -> list[int]:
        """Numbers of all versions, oldest first."""
        log = self._path(f"{self.root}/log")
        names = [s.getPath().getName() for s in self._files.listStatus(log)] if self._files.exists(log) else []
        return sorted(int(n) for n in names if re.fullmatch(r"\d{12}", n))

    def version(self, number: int | None = None) -> Version:
        """A version, the newest by default. A store without any is empty, at version 0."""
        known = self.versions()
        number = number if number is not None else (known[-1] if known else 0)
        if number == 0:
            return Version(0, {}, {})
        found = json.loads(self.spark.read.text(f"{self.root}/log/{number:012d}", wholetext=True).first()[0])
        return Version(number, found["tables"], found["batches"])

    def read(self, table: str, schema: str | StructType | None = None, number: int | None = None) -> DataFrame:
        """A table as a version has it. One that is not there yet is empty, if its schema is told."""
        found = self.version(number).tables.get(table)
        if found is None:
            if schema is None:
                raise KeyError(f"no table {table} in {self.root}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(*found["folders"])

    def _publish(self, version: Version) -> bool:
        """Make a version appear at once. False if its number is taken."""
        hidden = self._path(f"{self.root}/log/_{uuid.uuid4().hex}")
        out = self._files.create(hidden, False)
        out.write(json.dumps({"tables": version.tables, "batches": version.batches}).encode())
        out.close()
        never = self.spark.sparkContext._gateway.new_array(getattr(self._fs, "Options$Rename"), 0)
        try:
            self._context.rename(hidden, self._path(f"{self.root}/log/{version.number:012d}"), never)
        except Py4JJavaError as e:
            self._files.delete(hidden, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def commit(self, changes: dict[str, DataFrame], source: str | None = None, number: int = 0, replace: bool = False) -> int:
        """Append to tables, or ``replace`` them, in one change. Gives the version that holds it.

        A change of a source whose number is not above the last one is there already, and nothing is written. Writers
        that append at once follow each other; a replacement fails if the store changed meanwhile, for what it was made
        from is no longer all there is.
        """
        base = self.version()
        start = base.number
        if source is not None and base.batches.get(source, -1) >= number:
            return base.number
        made = {}
        for name, df in changes.items():
            folder = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(folder)
            made[name] = {"folders": [folder], "schema": json.loads(df.schema.json())}
        while True:
            if replace and base.number != start:
                raise Conflict(f"{self.root} is at version {base.number}, not {start}")
            tables = dict(base.tables)
            for name, part in made.items():
                before = [] if replace or name not in tables else tables[name]["folders"]
                tables[name] = {"folders": before + part["folders"], "schema": part["schema"]}
            batches = base.batches | ({source: number} if source is not None else {})
            if self._publish(Version(base.number + 1, tables, batches)):
                return base.number + 1
            base = self.version()
            if source is not None and base.batches.get(source, -1) >= number:
                return base.number
