"""Tables under versions: written aside, published by one small file, read as they were when they were opened.

folder/versions/<name>/ has a version's tables, folder/published/<number> names the version that counts from then on.
A number is taken by a rename that fails if another writer has it, so of two writers at once one fails and can try again.
What was being written when a job failed is never named, and a reader keeps its version until vacuum() takes it away.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: The layout that this code writes and reads.
SCHEMA_VERSION = 1


class SchemaMismatch(ValueError):
    """A version was written in a layout that this code doesn't read."""


@dataclass(frozen=True)
class Snapshot:
    """A published version: its number, the folder of its tables, and what was said of it."""

    spark: SparkSession
    number: int
    folder: str
    meta: dict = field(default_factory=dict)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")


class Versions:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(self._conf)
        self._jvm = jvm

    def _listed(self, name: str) -> list[str]:
        at = self._path(f"{self.folder}/{name}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        return [int(n) for n in self._listed("published") if n.isdigit()]

    def current(self, number: int | None = None) -> Snapshot | None:
        """The last version, or the one of a number; None if nothing is published. Another layout is an error."""
        known = self.numbers()
        if not known or (number is not None and number not in known):
            return None
        number = known[-1] if number is None else number
        stream = self._fs.open(self._path(f"{self.folder}/published/{number:010d}"))
        try:
            said = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        if said["schema"] != SCHEMA_VERSION:
            raise SchemaMismatch(f"{self.folder} has layout {said['schema']}, {SCHEMA_VERSION} is read here")
        return Snapshot(self.spark, number, f"{self.folder}/versions/{said['name']}", said["meta"])

    def publish(self, write: Callable[[str], dict | None], expected: int | None = None) -> Snapshot:
        """Call write(folder), which writes the tables and returns what to say of them, then publish the folder.

        expected is the number of the version that the new one is made from (0: none); if another one was published
        meanwhile, or comes first while this one is written, this fails with FileExistsError and nothing is published.
        """
        last = max(self.numbers(), default=0)
        if expected is not None and last != expected:
            raise FileExistsError(f"version {last} was published after {expected}")
        name = uuid.uuid4().hex
        meta = write(f"{self.folder}/versions/{name}") or {}
        number = last + 1
        self._fs.mkdirs(self._path(f"{self.folder}/published"))
        aside = self._path(f"{self.folder}/published/.{name}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"schema": SCHEMA_VERSION, "name": name, "meta": meta}).encode()))
        out.close()
        try:
            # renaming without the overwrite option fails if the number is taken
            files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self._conf)
            none = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(self._path(f"{self.folder}/published/{number:010d}")), none)
        except Exception as e:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(f"version {number} was published meanwhile") from e
            raise
        return Snapshot(self.spark, number, f"{self.folder}/versions/{name}", meta)

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete the tables of all but the last versions, and what failed writes left; readers of these must be done."""
        kept = self.numbers()[-keep:]
        names = {self.current(n).folder.rsplit("/", 1)[-1] for n in kept}
        for n in self.numbers():
            if n not in kept:
                self._fs.delete(self._path(f"{self.folder}/published/{n:010d}"), False)
        gone = [n for n in self._listed("versions") if n not in names]
        for n in gone:
            self._fs.delete(self._path(f"{self.folder}/versions/{n}"), True)
        return gone
