"""Written intermediate tables: they cut lineage and outlive lost executors."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Tables of the blocks of ``scratch`` that are open, innermost last.
_open: ContextVar[list[list[DataFrame]]] = ContextVar("open", default=[])


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. The cluster names it in ``spark.checkpoint.dir``; only where that is unset and all runs in one process (tests, a laptop) is one made here."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if not current:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="daybook-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def save(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and scan it back. A lost executor then costs only the tasks it ran."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._daybook_path = path
    if _open.get():
        _open.get()[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``save`` writes inside are deleted at the end, all but those that are passed to what this gives, which go to the block around it if there is one.

    What leaves the block may be read from kept tables only."""
    mine: list[DataFrame] = []
    kept: list[DataFrame] = []
    token = _open.set([*_open.get(), mine])

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _open.reset(token)
        stays = {df._daybook_path for df in kept}
        for df in mine:
            if df._daybook_path not in stays:
                drop(df)
        if _open.get():
            _open.get()[-1].extend(kept)


def drop(df: DataFrame) -> None:
    """Delete a table that ``save`` wrote, once nothing will read it again."""
    path = getattr(df, "_daybook_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let shuffle files of finished jobs go. Spark deletes them once the driver's collector has found that no plan refers to them, which a driver with memory to spare does late; after a large table is written that is what keeps two steps' files from lying side by side."""
    time.sleep(1)  # listeners hold the last plan until they were told of its end
    spark._jvm.System.gc()


def shrink_driver(spark: SparkSession) -> None:
    """Collect the driver's garbage, so that its heap gives back what plans of a loop took. Its collector lets the heap grow to the full size first, though little of it is in use."""
    spark._jvm.System.gc()
