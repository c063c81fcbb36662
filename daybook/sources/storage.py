"""Tables that joins needn't shuffle, and tables that are replaced whole or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has put down the version that this one was to be."""


def write_bucketed(df: DataFrame, name: str, key: str, buckets: int, path: str | None = None, sort: list[str] | None = None) -> DataFrame:
    """``df`` as table ``name`` in ``buckets`` files by ``key``, sorted inside by it and ``sort``. Tables with an equal number of buckets are joined and grouped by ``key`` without an exchange.

    Rows are dealt as the buckets are, so each is one file. A null key is a bucket's like any other. On a large table choose so many buckets that one of them fits a task."""
    writer = df.repartition(buckets, key).write.mode("overwrite").format("parquet").option("compression", "zstd").bucketBy(buckets, key).sortBy(key, *(sort or []))
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


class Versions:
    """A table of whole versions under ``path``: a version's data is written aside, and it exists once its mark does, which only one writer can make.

    Readers see the newest marked version, old or new and never half of one. Data without a mark (of a writer that died or lost) is read by no one; ``clean`` deletes it with versions that are no longer kept."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    @property
    def _system(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(f.getPath().getName() for f in self._system.listStatus(at)) if self._system.exists(at) else []

    def versions(self) -> list[int]:
        return [int(n) for n in self._names("marks") if n.isdigit()]

    def latest(self) -> int:
        """The newest version's number, 0 where there is none."""
        return max(self.versions(), default=0)

    def _data(self, version: int) -> str:
        stream = self._system.open(self._at("marks", f"{version:010d}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())["data"]
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version, the newest unless one is named; None where there is none."""
        version = self.latest() if version is None else version
        return self.spark.read.parquet(f"{self.path}/data/{self._data(version)}") if version else None

    def prepare(self, df: DataFrame, order: list[Column | str] | None = None) -> str:
        """Write data aside, sorted over all its files by ``order``; returns its name."""
        name = uuid.uuid4().hex
        (df.orderBy(*order) if order else df).write.option("compression", "zstd").parquet(f"{self.path}/data/{name}")
        return name

    def commit(self, name: str, after: int) -> int:
        """Make the data of that name the version behind ``after``. Raises ``Conflict`` where that version is there already.

        The mark is written aside and renamed; a rename onto a name that exists fails."""
        self._system.mkdirs(self._at("marks"))
        aside, mark = self._at("aside", name), self._at("marks", f"{after + 1:010d}")
        out = self._system.create(aside, True)
        out.write(bytearray(json.dumps({"data": name}).encode()))
        out.close()
        if self._system.exists(mark) or not self._system.rename(aside, mark) or self._data(after + 1) != name:
            raise Conflict(f"version {after + 1} of {self.path} is another writer's")
        return after + 1

    def write(self, df: DataFrame, order: list[Column | str] | None = None) -> int:
        """The next version. What ``df`` reads of this table is the version that was newest before."""
        after = self.latest()
        return self.commit(self.prepare(df, order), after)

    def upsert(self, new: DataFrame, key: str, order: list[Column | str], tries: int = 3, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Rows of ``new`` in place of those with their key, all sorted by ``order`` again; ``merge`` says otherwise how old and new rows become one table. A writer that came second reads the first one's version and tries again.

        A key that is null in ``new`` replaces nothing and is added."""
        from daybook.sources.sinks import upsert

        for n in range(1, tries + 1):
            after = self.latest()
            old = self.read(after) if after else None
            made = new if old is None else (merge or (lambda a, b: upsert(a, b, key)))(old, new)
            try:
                return self.commit(self.prepare(made, order), after)
            except Conflict:
                if n == tries:
                    raise
        raise ValueError("tries must be positive")

    def clean(self, keep: int = 2) -> list[str]:
        """Delete all data but that of the last ``keep`` versions; names of what went. Only while nobody writes."""
        marks = self.versions()
        stays = {self._data(v) for v in marks[-keep:]} if keep else set()
        for v in marks[: max(0, len(marks) - keep)]:
            self._system.delete(self._at("marks", f"{v:010d}"), False)
        gone = [n for n in self._names("data") if n not in stays]
        for n in gone:
            self._system.delete(self._at("data", n), True)
        return gone
