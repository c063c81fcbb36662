"""Appending a stream's batches to an event log, each once whatever happens to the job.

A batch's rows go to a folder of its own name, which a second try overwrites; a mark in the ledger, put down after them, makes them part of the log. A batch whose mark is there is left alone when Spark
runs it again. Readers see marked batches only. Places in a key's list go on from those of the marked batches before, so they are the same in every try."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Ledger:
    """The log under ``path`` as one stream writes it; streams that write to one log need different names."""

    def __init__(self, spark: SparkSession, path: str, stream: str = "main", key: str = "key"):
        self.spark, self.path, self.stream, self.key = spark, path.rstrip("/"), stream, key

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))

    @property
    def _system(self):
        return self._at().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def marked(self) -> list[str]:
        """Batches of all streams that are part of the log."""
        at = self._at("ledger")
        return sorted(f.getPath().getName() for f in self._system.listStatus(at)) if self._system.exists(at) else []

    def read(self, but: str | None = None) -> DataFrame | None:
        """The log, without one batch if that is named; None while it is empty."""
        names = [n for n in self.marked() if n != but]
        return self.spark.read.parquet(*(f"{self.path}/batches/{n}" for n in names)) if names else None

    def placed(self, batch: DataFrame, before: DataFrame | None) -> DataFrame:
        """``batch`` with ``pos``: behind what the log holds of the key, in order of time and kind."""
        order = Window.partitionBy(self.key).orderBy("at", *sorted(c for c in batch.columns if c not in (self.key, "at")))
        rows = batch.withColumn("pos", F.row_number().over(order).cast("long") - 1)
        if before is None:
            return rows
        last = before.groupBy(self.key).agg((F.max("pos") + 1).alias("__next"))
        return rows.join(last, self.key, "left").withColumn("pos", F.col("pos") + F.coalesce("__next", F.lit(0))).drop("__next").select(*rows.columns)

    def append(self, batch: DataFrame, number: int) -> bool:
        """Make a batch part of the log; False where it was already."""
        name = f"{self.stream}-{number:012d}"
        if self._system.exists(self._at("ledger", name)):
            return False
        self.placed(batch, self.read(but=name)).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/batches/{name}")
        self._system.mkdirs(self._at("ledger"))
        self._system.create(self._at("ledger", name), True).close()
        return True

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``."""
        return lambda batch, number: self.append(batch, number) and None
